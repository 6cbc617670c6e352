"""Removal of byte strings that also start in an earlier document, by suffix sorting.

Equal strings of `length` bytes pick the same anchor (the least hash of the short strings in them), so a run of strings
with one anchor is a segment that can be sent by its anchor to a shard where everything equal to it arrives. Anchors
go ahead of texts: those of one document alone end there, those whose segments are all alike are settled there, and
only segments that differ around an anchor are fetched, each distinct one once. A shard's segments are suffix-sorted
anchor by anchor: of anchors with few bytes, which equal strings never leave, many together in memory, as far as the
order of `length` symbols goes; an anchor with more bytes than that by external induced sorting (induced_sort). Runs of
suffixes sharing `length` symbols give, for each string, the smallest document that has it.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced_sort import capped_order, mapped, prefix_blocks, stored, suffix_array
from .jaccard_join import mix
from .shared import materialise, reclaim

U64 = np.uint64
_BASE = 0x9FB21C651E98DF25
_TABLE = mix(np.arange(256, dtype=U64) + U64(0xC2B2AE3D27D4EB4F))
_POWERS: list[np.ndarray] = []
#: Texts of about so many bytes are hashed at a time.
BLOCK = 1 << 19
#: Rows of a batch handed back, and text bytes whose segments a bucket is meant to hold.
ROWS, BUCKET_BYTES = 50_000, 8 << 20
#: Bytes of segments that are sorted in memory; an anchor with more is sorted on disk.
HELD = 1 << 18


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, BLOCK * 2)
        _POWERS[:] = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(n, b, U64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, in three passes."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(U64).max, U64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(raw: np.ndarray, owner: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Segments of joined texts (owner: the text of each byte): text, start in raw, bytes, hash of the anchor, hash of
    the segment, and hashes of what stands in it just before and after the anchor (0 where it is too short). Every
    string of `length` bytes inside a text lies in exactly one segment. Equal strings share the anchor and, as one side
    of it has at least half of the other bytes, the hash before it or the one after it."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.astype(U64), none.astype(U64), none.astype(np.uint16), none.astype(np.uint16)
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(_TABLE[raw] * up[: len(raw)])])
    at = np.arange(len(raw) - anchor + 1)
    grams = mix((sums[anchor:] - sums[:-anchor]) * down[at])
    # the hash decides, then the leftmost place
    place = (grams & ~U64((1 << 24) - 1)) | at.astype(U64)
    chosen = (_least_of(place, length - anchor + 1) & U64((1 << 24) - 1)).astype(np.int64)
    inside = owner[: len(chosen)] == owner[length - 1 :]
    first = inside.copy()
    first[1:] &= (chosen[1:] != chosen[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (chosen[1:] != chosen[:-1]) | ~inside[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + length
    content = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U64) * U64(0xD6E8FEB86659FD93))
    half, place = -(-(length - anchor) // 2), chosen[start]
    left, right = place - half, place + anchor
    has_left, has_right = left >= start, right + half <= stop
    left, right = np.where(has_left, left, start), np.where(has_right, right, start)
    before = np.where(has_left, mix((sums[left + half] - sums[left]) * down[left]) >> U64(48) | U64(1), U64(0)).astype(np.uint16)
    after = np.where(has_right, mix((sums[right + half] - sums[right]) * down[right]) >> U64(48) | U64(1), U64(0)).astype(np.uint16)
    return owner[start], start, stop - start, grams[place], content, before, after


def _blocks(batches, length: int):
    """Documents joined in blocks of about BLOCK bytes: ids, tags, offsets of each within its text, raw bytes, owner of
    each byte. A text longer than a block comes in parts that overlap by length - 1 bytes."""
    ids, tags, offsets, parts, size = [], [], [], [], 0
    for batch in batches:
        for doc, tag, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            data = (text or "").encode()
            for at in range(0, max(1, len(data) - length + 1), BLOCK):
                part = data[at : at + BLOCK + length - 1]
                if len(part) < length:
                    continue
                ids.append(doc), tags.append(tag), offsets.append(at), parts.append(part)
                size += len(part)
                if size >= BLOCK:
                    yield ids, tags, np.array(offsets), np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                    ids, tags, offsets, parts, size = [], [], [], [], 0
    if parts:
        yield ids, tags, np.array(offsets), np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def planes(x: np.ndarray) -> bytes:
    """The values' first bytes, then their second bytes, and so on: high bytes are much alike, so this packs better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplaned(data: bytes, kind) -> np.ndarray:
    """The values that planes() was given."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


COLUMNS = ["anchors", "contents", "docs", "tags", "starts", "sizes", "befores", "afters"]
SENT = "bucket int, " + ", ".join(f"{c} binary" for c in COLUMNS)
SETTLED = "kind string, doc long, tag int, start long, size long, anchor long, content long, least long"


def settle(docs: DataFrame, length: int, anchor: int, buckets: int) -> DataFrame:
    """docs(doc, tag, text) to rows of kind 'cut' (doc, tag, start, size: to be removed), 'open' (doc, tag, start, size,
    anchor, content: depends on a segment that must be sorted) and 'fetch' (one row for each distinct such segment:
    where to find it, and the smallest document that has it). The tag is a hash of the text: rows that repeat a doc_id
    with different texts are cut each at its own places."""

    def send(batches):
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            bucket = (columns[0] >> U64(32)) % U64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=U64))
            full = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in full], pa.int32()), *(pa.array([planes(c[o]) for _, o in full], pa.binary()) for c in columns)], names=["bucket", *COLUMNS])

        for ids, tags, offsets, raw, owner in _blocks(batches, length):
            text, start, size, anchors, contents, left, right = segments(raw, owner, length, anchor)
            before = np.searchsorted(owner, np.arange(len(ids)))
            held.append((anchors, contents, np.array(ids, np.int64)[text], np.array(tags, np.int32)[text], (start - before[text] + offsets[text]).astype(np.uint32), size.astype(np.uint16), left, right))
            count += len(text)
            if count >= 600_000:
                yield flush()
                count = 0
        if held:
            yield flush()

    kinds = [U64, U64, np.int64, np.int32, np.uint32, np.uint16, np.uint16, np.uint16]

    def joined(parts, k, kind):
        """Column k of the parts, which lose it."""
        out, at = np.empty(sum(len(p[k]) for p in parts) // np.dtype(kind).itemsize, kind), 0
        for p in parts:
            piece = unplaned(p[k], kind)
            out[at : at + len(piece)] = piece
            at += len(piece)
            p[k] = b""
        return out

    def gather(batches):
        parts = [[c.as_py() for c in row] for b in batches for row in zip(*(b.column(k) for k in range(1, len(kinds) + 1)), strict=True)]
        if not parts:
            return
        anchors, contents, owners, tags, starts, sizes, lefts, rights = (joined(parts, k, kind) for k, kind in enumerate(kinds))
        del parts
        order = np.argsort(anchors, kind="stable")
        sorted_anchors = anchors[order]
        same = np.concatenate([[False], sorted_anchors[1:] == sorted_anchors[:-1]])
        order = order[same | np.concatenate([same[1:], [False]])]
        del sorted_anchors, same
        anchors, contents, owners, tags, starts, sizes, lefts, rights = (c[order] for c in (anchors, contents, owners, tags, starts, sizes, lefts, rights))
        if not len(anchors):
            return
        low, shared, alike = owners.copy(), np.zeros(len(owners), bool), np.ones(len(owners), bool)
        for side in (lefts, rights):
            rows = np.flatnonzero(side)
            keys = mix(anchors[rows] ^ mix(side[rows].astype(U64)))
            rows, keys = rows[o := np.argsort(keys, kind="stable")], keys[o]
            if not len(rows):
                continue
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            count = np.diff(np.append(begin, len(keys)))
            least, most = (np.repeat(f.reduceat(owners[rows], begin), count) for f in (np.minimum, np.maximum))
            low[rows] = np.minimum(low[rows], least)
            shared[rows] |= least != most
            alike[rows] &= np.repeat(np.minimum.reduceat(contents[rows], begin) == np.maximum.reduceat(contents[rows], begin), count)
        cut = shared & alike & (owners > low)
        yield from _rows("cut", owners[cut], tags[cut], starts[cut], sizes[cut])
        keep = shared & ~alike
        anchors, contents, owners, tags, starts, sizes = (c[keep] for c in (anchors, contents, owners, tags, starts, sizes))
        del lefts, rights, low, shared, alike, cut, keep
        yield from _rows("open", owners, tags, starts, sizes, anchors, contents)
        if len(anchors):
            order = np.lexsort((owners, contents, anchors))
            first = order[np.concatenate([[True], (anchors[order][1:] != anchors[order][:-1]) | (contents[order][1:] != contents[order][:-1])])]
            yield from _rows("fetch", owners[first], tags[first], starts[first], sizes[first], anchors[first], contents[first], owners[first])

    def _rows(kind, doc, tag, start, size, *optional):
        for at in range(0, len(doc), ROWS):
            part = slice(at, at + ROWS)
            n = len(doc[part])
            given = [pa.array(np.ascontiguousarray(x[part]).view(np.int64)) for x in optional]
            columns = [pa.array([kind] * n, pa.string()), pa.array(doc[part]), pa.array(tag[part]), pa.array(start[part].astype(np.int64)), pa.array(size[part].astype(np.int64)), *given]
            columns += [pa.nulls(n, pa.int64())] * (3 - len(given))
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "doc", "tag", "start", "size", "anchor", "content", "least"])

    sent = docs.mapInArrow(send, SENT)
    return materialise(sent.repartition(buckets, "bucket").mapInArrow(gather, SETTLED), "settled")


def sort_shard(rows: Iterable[tuple[int, int, int, bytes]], length: int, folder: str) -> Iterator[tuple[int, int, int, int, int]]:
    """rows (anchor, content, least, text) of a shard, to runs (anchor, content, start, stop, doc): every string of
    `length` bytes that begins in [start, stop) of the text has `doc` as its smallest document. Texts are closed by 0,
    which no byte is (none is 255 in UTF-8), and sorted together. They, what belongs to them and all lists over their
    bytes are files in folder."""
    facts: list[list[int]] = []
    end = 0

    def symbols():
        nonlocal end
        for anchor, content, least, text in rows:
            if len(text) >= length:
                facts.append([anchor, content, least, end, len(text)])
                end += len(text) + 1
                yield np.append(np.frombuffer(text, np.uint8) + np.uint8(1), np.uint8(0))
            if len(facts) >= 20_000:
                np.array(facts, np.int64).tofile(spill)
                facts.clear()

    with tempfile.TemporaryFile(dir=folder) as spill:
        t = stored(folder, symbols(), np.uint8)
        if not len(t):
            return
        np.array(facts, np.int64).tofile(spill)
        facts.clear()
        spill.flush()
        about = np.memmap(spill, np.int64, "r").reshape(-1, 5)
    leasts, begins = (stored(folder, (about[at : at + BLOCK, c] for at in range(0, len(about), BLOCK))) for c in (2, 3))
    sa = suffix_array(t, folder)
    # the group of each suffix, numbered in order, and each group's smallest document
    group, smallest, last = mapped(folder, len(t), np.int64), mapped(folder, len(t), np.int64), -1
    for at, shared in prefix_blocks(t, sa, length):
        new = shared < length
        groups = last + np.cumsum(new)
        docs = leasts[np.searchsorted(begins, at, "right") - 1]
        first = np.flatnonzero(np.concatenate([[True], new[1:]]))
        least = np.minimum.reduceat(docs, first)
        if not new[0]:
            least[0] = min(least[0], smallest[last])
        smallest[groups[first]] = least
        group[at] = groups
        last = int(groups[-1])
    for anchor, content, _, at, size in (x for k in range(0, len(about), 20_000) for x in about[k : k + 20_000].tolist()):
        docs = smallest[group[at : at + size - length + 1]]
        edges = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1], [True]]))
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            yield anchor, content, a, b, int(docs[a])


def sort_held(rows: list[tuple[int, int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """sort_shard() in memory: its runs as columns."""
    anchors, contents, leasts = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    sizes = np.array([len(r[3]) for r in rows], np.int64)
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    order, new = capped_order(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), (np.cumsum(sizes) - sizes)[owner] + inside, length)
    if not len(order):
        return anchors[:0], contents[:0], inside, inside, leasts[:0]
    docs = np.empty(len(owner), np.int64)
    docs[order] = np.minimum.reduceat(leasts[owner[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    begin = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (owner[1:] != owner[:-1])]))
    of = owner[begin]
    return anchors[of], contents[of], inside[begin], inside[begin] + np.diff(np.append(begin, len(owner))), docs[begin]


def sort_by_anchor(rows: Iterable[tuple[int, int, int, bytes]], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs of rows sorted by anchor, as columns."""
    held, size = [], 0
    for _, group in groupby(rows, key=lambda row: row[0]):
        own, own_size = [], 0
        for row in group:
            own.append(row)
            own_size += len(row[3])
            if own_size > HELD:
                break
        if own_size > HELD:
            with tempfile.TemporaryDirectory() as folder:
                found = sort_shard(chain(own, group), length, folder)
                while flat := list(islice(found, 20_000)):
                    yield tuple(np.array(c, np.int64) for c in zip(*flat, strict=True))
            continue
        held += own
        size += own_size
        if size > HELD:
            yield sort_held(held, length)
            held, size = [], 0
    if held:
        yield sort_held(held, length)


def remove_spans(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, int, int]:
    """data without the spans; bytes removed; maximal runs removed. Spans may overlap."""
    if not len(starts):
        return data, 0, 0
    depth = np.zeros(len(data) + 1, np.int64)
    np.add.at(depth, np.minimum(starts, len(data)), 1)
    np.add.at(depth, np.minimum(stops, len(data)), -1)
    gone = np.cumsum(depth)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def suffix_dedup(docs: DataFrame, length: int = 50, anchor: int = 24, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A byte is removed if a string of `length` bytes over it also starts in a document with a smaller doc_id. Null text:
    empty. Texts shorter than `length` stay whole. A null doc_id has nothing removed and removes nothing. Rows that
    repeat a doc_id count as one document, and each is cut at its own places. Strings that stand in equal surroundings
    everywhere are told to be equal by 128 bits of hashes, others by their bytes. Extra columns are ignored. An empty
    table gives no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_col).cast("long").alias("doc"), F.hash(text_col).alias("tag"), F.col(text_col).alias("text"))
    texts = rows.where("doc IS NOT NULL")
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    settled = settle(texts, length, anchor, buckets)
    reclaim(spark)

    wanted = settled.where("kind = 'fetch'").groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "size", "anchor", "content", "least")).alias("wanted"))

    def fetch(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                for w in wants:
                    for column, value in zip(out, (w["anchor"], w["content"], w["least"], data[w["start"] : w["start"] + w["size"]]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["anchor", "content", "least", "data"])

    def sort(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for columns in sort_by_anchor(rows, length):
            for at in range(0, len(columns[0]), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + ROWS]) for c in columns], names=["anchor", "content", "first", "stop", "least"])

    fetched = texts.join(wanted, ["doc", "tag"]).select("text", "wanted").mapInArrow(fetch, "anchor long, content long, least long, data binary").dropDuplicates(["anchor", "content"])
    verdicts = materialise(fetched.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, "anchor long, content long, first long, stop long, least long"), "verdicts")
    reclaim(spark)
    judged = settled.where("kind = 'open'").select("doc", "tag", "start", "anchor", "content").join(verdicts, ["anchor", "content"]).where("doc > least")
    cuts = settled.where("kind = 'cut'").select("doc", "tag", "start", (F.col("start") + F.col("size")).alias("stop"))
    cuts = cuts.unionByName(judged.select("doc", "tag", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("stop") + (length - 1)).alias("stop")))
    by_doc = cuts.groupBy("doc", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def remove(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, starts, stops in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                kept, removed, runs = remove_spans(data, np.array(starts or [], np.int64), np.array(stops or [], np.int64))
                for column, value in zip(out, (doc, len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(by_doc, ["doc", "tag"], "left").select("doc", "text", "starts", "stops")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_dedup_query(docs: DataFrame) -> DataFrame:
    """Contract of op4."""
    return suffix_dedup(docs).drop("kept")
