"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on a bounded sample of labelled windows. Over a
text it labels every byte position in windows of fixed length; a document's probabilities are the mean over all its
positions. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: What may be a letter; has_letter() leaves out the numbers among them.
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """True if text holds a character of a Unicode letter category."""
    return any(m.group().isalpha() for m in _WORD.finditer(text))


@dataclass
class Settings:
    """Bounds and sizes of training. sample_windows bounds what is fitted, whatever the table's size."""

    hidden: int = 8
    window: int = 64
    sample_windows: int = 6000
    windows_per_document: int = 4
    steps: int = 200
    batch: int = 200
    rate: float = 0.02
    seed: int = 7


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class ByteNetwork:
    """Two gated recurrent layers, one each way, and a softmax over both at every position.

    Arrays are feature by sequence, so gates are contiguous. Per direction: input table E (3H x 256) with the biases,
    recurrent weights U (3H x H); gates in the order update, reset, candidate."""

    def __init__(self, classes: list[str], s: Settings):
        rng = np.random.default_rng(s.seed)
        h, c = s.hidden, len(classes)
        self.classes, self.hidden = classes, h
        self.p = {}
        for d in "fb":
            self.p["E" + d] = rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
            self.p["U" + d] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(np.float32)
            self.p["V" + d] = rng.normal(0, 1 / np.sqrt(h), (c, h)).astype(np.float32)
        self.p["o"] = np.zeros((c, 1), np.float32)

    def _steps(self, d: str, x: np.ndarray, keep: bool):
        """States over x (T x B bytes), and what backpropagation needs."""
        h, (t_end, b) = self.hidden, x.shape
        e, u = self.p["E" + d], self.p["U" + d]
        states = np.empty((t_end, h, b), np.float32)
        held, s = [], np.zeros((h, b), np.float32)
        for t in range(t_end) if d == "f" else range(t_end - 1, -1, -1):
            ex, us = np.take(e, x[t], axis=1), u @ s
            zr = _sigmoid(ex[: 2 * h] + us[: 2 * h])
            z, r = zr[:h], zr[h:]
            n = np.tanh(ex[2 * h :] + r * us[2 * h :])
            before, s = s, n + z * (s - n)
            states[t] = s
            if keep:
                held.append((t, before, z, r, n, us[2 * h :]))
        return states, held

    def _probabilities(self, fwd, bwd):
        y = self.p["Vf"] @ fwd + self.p["Vb"] @ bwd + self.p["o"]
        y = np.exp(y - y.max(axis=-2, keepdims=True))
        return y / y.sum(axis=-2, keepdims=True)

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities at every position of x (T x B bytes): T x classes x B."""
        return self._probabilities(self._steps("f", x, False)[0], self._steps("b", x, False)[0])

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over unmasked positions and its gradients, by backpropagation through time."""
        h, weight = self.hidden, (mask / max(mask.sum(), 1)).astype(np.float32)
        (fwd, held_f), (bwd, held_b) = self._steps("f", x, True), self._steps("b", x, True)
        y = self._probabilities(fwd, bwd)
        at = np.arange(x.shape[1])
        loss = -float((np.log(y[:, target, at] + 1e-9) * weight).sum())
        y[:, target, at] -= 1
        y *= weight[:, None, :]
        g = {"o": y.sum(axis=(0, 2))[:, None]}
        for d, states, held in (("f", fwd, held_f), ("b", bwd, held_b)):
            u, de, du = self.p["U" + d], np.zeros((256, 3 * h), np.float32), np.zeros((3 * h, h), np.float32)
            g["V" + d] = np.einsum("tcb,thb->ch", y, states, optimize=True)
            ds = np.zeros_like(states[0])
            for t, before, z, r, n, un in reversed(held):
                ds = ds + self.p["V" + d].T @ y[t]
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (before - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                da = np.concatenate([dz, dr, dn])
                np.add.at(de, x[t], da.T)
                da[2 * h :] = dn * r
                du += da @ before.T
                ds = ds * z + u.T @ da
            g["E" + d], g["U" + d] = de.T, du
        return loss, g

    def fit(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, s: Settings) -> float:
        """Adam over shuffled batches of windows (T x N). Returns the last batch's loss."""
        rng, loss, order = np.random.default_rng(s.seed), 0.0, np.zeros(0, int)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, s.steps + 1):
            while len(order) < s.batch:
                order = np.append(order, rng.permutation(x.shape[1]))
            pick, order = order[: s.batch], order[s.batch :]
            loss, g = self.gradients(x[:, pick], mask[:, pick], target[pick])
            rate = s.rate * (1 - (step - 1) / s.steps)
            for k, grad in g.items():
                m[k] += 0.1 * (grad - m[k])
                v2[k] += 0.01 * (grad * grad - v2[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Forward passes only, with the sigmoids folded into one tanh a step: sigmoid(x) = (1 + tanh(x / 2)) / 2."""

    def __init__(self, net: ByteNetwork):
        h = self.hidden = net.hidden
        self.classes = net.classes
        self.p = {k: v.copy() for k, v in net.p.items()}
        for d in "fb":
            for k in ("E", "U"):
                self.p[k + d][: 2 * h] *= 0.5

    def _walk(self, d: str, x: np.ndarray, states: np.ndarray | None, use) -> None:
        h, (t_end, b) = self.hidden, x.shape
        e, u = self.p["E" + d], self.p["U" + d]
        s, a, un = np.zeros((h, b), np.float32), np.empty((3 * h, b), np.float32), np.empty((3 * h, b), np.float32)
        z, r, n = a[:h], a[h : 2 * h], a[2 * h :]
        for t in range(t_end) if d == "f" else range(t_end - 1, -1, -1):
            np.take(e, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, s, out=un)
            a[: 2 * h] += un[: 2 * h]
            np.tanh(a[: 2 * h], out=a[: 2 * h])
            r += 1
            r *= 0.5
            r *= un[2 * h :]
            n += r
            np.tanh(n, out=n)
            z += 1
            z *= 0.5
            s -= n
            s *= z
            s += n
            if states is not None:
                states[t] = s
            if use is not None:
                use(t, s)

    def pooled(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Sum of the class probabilities over the unmasked positions of each window (T x B): classes x B."""
        states = np.empty((x.shape[0], self.hidden, x.shape[1]), np.float32)
        total = np.zeros((len(self.classes), x.shape[1]), np.float32)
        self._walk("f", x, states, None)

        def label(t, s):
            y = self.p["Vf"] @ states[t]
            y += self.p["Vb"] @ s
            y += self.p["o"]
            np.exp(y, out=y)
            y *= mask[t] / y.sum(axis=0)
            np.add(total, y, out=total)

        self._walk("b", x, None, label)
        return total


def windows_of(raw: bytes, length: int) -> np.ndarray:
    """raw in rows of `length` bytes, the last filled with zeros."""
    n = -(-len(raw) // length)
    out = np.zeros(n * length, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, length)


def position_labels(net: ByteNetwork, text: str, window: int = 64) -> list[str]:
    """The most probable language at each byte of text."""
    raw = text.encode()
    if not raw:
        return []
    best = net.positions(np.ascontiguousarray(windows_of(raw, window).T)).argmax(axis=1)
    return [net.classes[c] for c in best.T.ravel()[: len(raw)]]


def document_probabilities(scorer: Scorer, texts: list[bytes], window: int, block: int = 4096) -> np.ndarray:
    """Mean class probabilities over all byte positions of each text; zeros for an empty text. Windows of many texts
    go through the network together, `block` at a time, so memory does not grow with the texts."""
    out = np.zeros((len(texts), len(scorer.classes)))
    held, owners, sizes = [], [], []

    def flush():
        rows, who, size = np.concatenate(held), np.concatenate(owners), np.concatenate(sizes)
        for at in range(0, len(rows), block):
            x = np.ascontiguousarray(rows[at : at + block].T)
            mask = (np.arange(window)[:, None] < size[at : at + block]).astype(np.float32)
            np.add.at(out, who[at : at + block], scorer.pooled(x, mask).T)
        held.clear(), owners.clear(), sizes.clear()

    waiting = 0
    for k, raw in enumerate(texts):
        if not raw:
            continue
        rows = windows_of(raw, window)
        size = np.full(len(rows), window)
        size[-1] = len(raw) - window * (len(rows) - 1)
        held.append(rows), owners.append(np.full(len(rows), k)), sizes.append(size)
        waiting += len(rows)
        if waiting >= 4 * block:
            flush()
            waiting = 0
    if held:
        flush()
    return out / np.maximum([[len(t)] for t in texts], 1)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, s: Settings) -> list[tuple[str, bytes]]:
    """(lang, window) from documents with a language that are not held out: for each language, however many there are,
    an even share of sample_windows and one document at least, from documents chosen by hash over the whole table and
    at places over their whole texts. Rows that repeat a doc_id and text are one document, so what comes to the driver
    is about 1.2 times sample_windows and one document a language."""
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    rank = F.pmod(F.xxhash64("doc_id", "text", F.lit(s.seed)), F.lit(1 << 30)) / float(1 << 30)
    usable = usable.withColumn("rank", rank)
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")).collect()
    if not counts:
        return []
    want = max(1, s.sample_windows // (len(counts) * s.windows_per_document))
    # every language has a document in it, the one with the least rank at least
    shares = docs.sparkSession.createDataFrame([(r.lang, 1.2 * want / r.n, r.first) for r in counts], "lang string, share double, first double")
    chosen = usable.join(F.broadcast(shares), "lang").where((F.col("rank") < F.col("share")) | (F.col("rank") <= F.col("first"))).select("lang", "rank", "text").dropDuplicates(["lang", "rank"])
    size, each, seed = s.window, s.windows_per_document, s.seed

    def cut(batches):
        for batch in batches:
            rows = []
            for lang, order, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, rng = text.encode(), np.random.default_rng([seed, int(order * (1 << 30))])
                for at in rng.integers(0, max(1, len(raw) - size + 1), each):
                    rows.append((lang, order, raw[at : at + size]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "rank", "window"])

    found = sorted((r.lang, r.rank, bytes(r.window)) for r in chosen.mapInArrow(cut, "lang string, rank double, window binary").collect())
    by_lang: dict[str, list] = {}
    for lang, _, window in found:
        by_lang.setdefault(lang, []).append(window)
    return [(lang, w) for lang, ws in by_lang.items() for w in ws[: want * each]]


def train(docs: DataFrame, s: Settings) -> ByteNetwork | None:
    """A network fitted on docs(doc_id, text, lang), or None without a labelled row."""
    sample = training_windows(docs, s)
    if not sample:
        return None
    classes = sorted({lang for lang, _ in sample})
    x = np.ascontiguousarray(np.concatenate([windows_of(w, s.window) for _, w in sample]).T)
    mask = (np.arange(s.window)[:, None] < np.array([len(w) for _, w in sample])).astype(np.float32)
    target = np.array([classes.index(lang) for lang, _ in sample])
    net = ByteNetwork(classes, s)
    net.fit(x, mask, target, s)
    return net


def identify(docs: DataFrame, settings: Settings | None = None, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Trains on rows with a language whose crc32(doc_id as text) mod 4 is not 2, at most sample_windows windows; only the
    text's bytes are inputs. score is the document's probability of lang_pred; null texts, texts without a letter and,
    without any labelled row, all texts are 'und' with score 0. A null doc_id counts as not held out. Ties go to the
    first language by name. Repeated rows give a row each. Extra columns are ignored."""
    s = settings or Settings()
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    net = train(rows, s)
    scorer, window = net.scorer() if net else None, s.window

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(2).to_pylist()
                known = [bool(scorer and t and has_letter(t)) for t in texts]
                if scorer:
                    p = document_probabilities(scorer, [t.encode() if k else b"" for t, k in zip(texts, known, strict=True)], window)
                    p = p.round(6)  # sums of floats depend on what else is in the batch
                    best, top = p.argmax(axis=1), p.max(axis=1)
                names = [scorer.classes[best[k]] if ok else UNKNOWN for k, ok in enumerate(known)]
                points = [min(1.0, float(top[k])) if ok else 0.0 for k, ok in enumerate(known)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(points, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id_query(docs: DataFrame) -> DataFrame:
    """Contract of op8."""
    return identify(docs)
