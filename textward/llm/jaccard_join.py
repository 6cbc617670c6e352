"""Exact n-gram Jaccard join by universe-partition pigeonhole.

Sets of similar size share a layout, which hashes the universe of n-grams into segments. Two sets that link differ in
at most H of their elements, so of more than H segments some agree whole; of half as many, some differ by one element
at most and meet in a one-deletion neighbour. Each layout takes whichever of the two allocations costs less, with a few
spare segments. Spare segments make empty and small segments needless for a set that has no more of them than spares;
pairs of sets that both have more meet by their least elements (prefix filter). Candidates are verified exactly.

Equal sets are one node and joined once. A group of nodes with one key is a star around the member that meets most
others. The members under one centre that sizes and parts allow to link with another of their group are its pool. A
pool that fits in memory is solved in one task, to which each of its sets is sent once (`pool_links`). Under centres of
larger pools a group that its star leaves in several components is taken apart by its members' differences from the
centre: two sets that link share more than half of them (`centre_keys`), so they meet again under those elements. Of
these smaller groups those with few members are compared in memory, the others get centres of their own, and so on until
no group lies in several components. No group's pairs are ever listed, and nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, materialise, reclaim, row_numbers

U64 = np.uint64
#: Keys sent at a time, sets of one sending from which on a key counts as frequent, and keys a bucket is meant to hold.
FLUSH, OFTEN, KEYS_A_BUCKET = 1_000_000, 16, 2_000_000
#: Groups of a later round with so many members at most are compared in memory; larger ones get centres of their own.
COMPARED = 256
#: Groups of keys with so many members at most lose, by their parts, the members that can link with no other.
SIFTED = 4096
#: Elements of sets under one centre, or of differences from it, about, that a task holds, and the most sets.
POOLED, SOLVED = 2_000_000, 4096
#: Sets up to which the ids of their documents are sent to every task, so that the texts stay where they are.
SENT = 2_000_000
#: Ways in which a set takes part in a group of a later round.
ROLES = ["linked", "apart", "rest", "far"]
#: Parts of the universe whose sizes bound a difference from below.
PARTS = 96
#: Sets are smaller than this.
LARGEST = 1 << 34
#: Weight of a candidate against a key in the cost of an allocation, and how fast candidates thin out with a segment's size.
COLLISIONS, THINNING = 10.0, 0.5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BYTES[list(b" \t\n\x0b\x0c\r")] = 0
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\x0b\x0c\r")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x2545F4914F6CDD1D
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 18)
        _POWERS[:] = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(n, b, U64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of each word (run without ASCII white space) of UTF-8 bytes, A-Z lower-cased."""
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    white = _WHITE[b]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(b))
    sums = np.add.reduceat(_BYTES[b] * up[: len(b)], starts)
    ends = np.flatnonzero(~white & np.concatenate([white[1:], [True]]))
    return mix(sums * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the `size`-word shingles; of a shorter text, of all its words as one; empty without."""
    w = word_hashes(raw)
    if not len(w):
        return w
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, U64)
    for k in range(n):
        h = mix(h * U64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


@dataclass(frozen=True)
class Layout:
    """The segments of one size band: how many, whether neighbours by one deletion are used, and how many are spare."""

    number: int
    segments: int
    deletions: bool
    spare: int


@dataclass(frozen=True)
class Bands:
    """Size bands and their layouts for links of percent * union <= 100 * intersection. A set of size n is indexed in
    the layouts of its own band and the next, which cover every size it can link with."""

    percent: int = 85

    def band(self, n: int) -> int:
        return math.floor(math.log(n) / -math.log(self.percent / 100) + 1e-9)

    def layout(self, number: int) -> Layout:
        # the largest size of the band, found by its definition so that rounding cannot split a pair
        top, above = 1, 4 + int(1.01 * (100 / self.percent) ** (number + 1))
        while above - top > 1:
            middle = (top + above) // 2
            top, above = (middle, above) if self.band(middle) <= number else (top, middle)
        # a link of sizes s and t has s + t - 2i different elements, i at least percent (s + t) / (100 + percent)
        most = (100 - self.percent) * 2 * top // (100 + self.percent)
        spare = 1 + most // 8 if most > 1 else 0
        whole, halves = most + 1 + spare, most // 2 + 1 + (spare + 1) // 2
        cost = {
            False: whole * (1 + COLLISIONS * THINNING ** (top / whole)),
            True: (halves + top) * (1 + COLLISIONS * THINNING ** (top / halves)),
        }
        return Layout(number, halves, True, (spare + 1) // 2) if cost[True] < cost[False] else Layout(number, whole, False, spare)


def _segments(u: np.ndarray, layout: Layout) -> np.ndarray:
    h = mix(u ^ mix(np.array([layout.number + 1], U64)))
    return ((h >> U64(32)) * U64(layout.segments) >> U64(32)).astype(np.int64)


def layout_keys(u: np.ndarray, layout: Layout, percent: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Keys of the sorted set u in a layout; how many of its segments have none (or, with deletions, no neighbours
    beyond the empty set); and the prefix keys, to be used if that is more than the spares."""
    seg = _segments(u, layout)
    values = mix(u + U64(0x51ED270B))
    sums, counts = np.zeros(layout.segments, U64), np.bincount(seg, minlength=layout.segments)
    np.add.at(sums, seg, values)
    salt = mix(np.arange(layout.segments, dtype=U64) + U64(layout.number + 1 << 32))
    full = np.flatnonzero(counts)
    keys = mix(sums[full] ^ salt[full])
    weak = int((counts == 0).sum())
    if layout.deletions:
        weak = int((counts < 2).sum())
        big = counts[seg] > 1
        keys = np.unique(np.concatenate([keys, mix((sums[seg[big]] - values[big]) ^ salt[seg[big]])]))
    length = len(u) - -(-percent * len(u) // 100) + 1
    return keys, weak, mix(u[:length] ^ salt[0] ^ U64(0xA5A5A5A5A5A5A5A5))


def digest(u: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    one, two = mix(u).sum(dtype=U64), (mix(u ^ U64(0x7F4A7C15)) | U64(1)).sum(dtype=U64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _sets(batches, size: int):
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield doc, shingle_set((text or "").encode(), size)


def describe_sets(rows: DataFrame, size: int) -> DataFrame:
    """rows(row, doc, text) to row, doc, n (size of its set), k1 and k2 (digest of the set) and parts
    (the set's sizes in PARTS parts of the universe, 127 at most: two sets differ in at least the sum of the differences
    of their parts)."""

    def describe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                out: list[list] = [[], [], [], []]
                for _, u in _sets([part.select(["doc", "text"])], size):
                    parts = np.bincount((mix(u) >> U64(32)).astype(np.int64) % PARTS, minlength=PARTS)
                    for column, value in zip(out, (len(u), *digest(u), np.minimum(parts, 127).astype(np.int8)), strict=True):
                        column.append(value)
                columns = [part.column("row"), part.column("doc"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.list_(pa.int8()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc", "n", "k1", "k2", "parts"])

    return materialise(rows.select("row", "doc", "text").mapInArrow(describe, "row long, doc long, n long, k1 long, k2 long, parts array<tinyint>"), "sets")


def key_groups(rows: DataFrame, size: int, bands: Bands, buckets: int) -> DataFrame:
    """key, k1 of every key that more than one distinct set has, once for each set.

    Keys travel as arrays by bucket of the key, copies met in one batch once. A key that OFTEN or more sets of one
    batch have is known to be shared: its rows go to buckets of their own by batch, and only one of them to the key's
    bucket, so no bucket receives a frequent key's rows. A bucket's task holds one entry for each key and set."""

    def send(batches):
        held_keys, held_owners, count, flushed = [], [], 0, 0
        seen: set[tuple[int, int]] = set()

        def flush():
            nonlocal flushed
            keys, owners = np.concatenate(held_keys), np.concatenate(held_owners)
            held_keys.clear(), held_owners.clear(), seen.clear()
            order = np.argsort(keys, kind="stable")
            new = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
            first, often = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
            first[order] = new
            often[order] = np.repeat(counts := np.diff(np.append(np.flatnonzero(new), len(keys))), counts) >= OFTEN
            flushed += 1
            home = (keys >> U64(40)) % U64(buckets)
            away = mix(keys ^ mix(np.array([TaskContext.get().partitionId() << 20 | flushed], U64))) % U64(buckets)
            normal = ~often | first
            out = []
            for chosen, bucket, shared in ((normal, home, False), (often & ~first, away, True)):
                at = np.flatnonzero(chosen)
                at = at[np.argsort(bucket[at], kind="stable")]
                cuts = np.searchsorted(bucket[at], np.arange(buckets + 1, dtype=U64))
                out += [(k, shared, at[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in out], pa.int32()), pa.array([x for _, x, _ in out], pa.bool_()), *(pa.array([x[o].tobytes() for _, _, o in out], pa.binary()) for x in (keys, owners))],
                names=["bucket", "shared", "keys", "owners"],
            )

        for _, u in _sets(batches, size):
            if not len(u):
                continue
            owner = digest(u)
            if owner in seen:
                continue
            seen.add(owner)
            own = bands.band(len(u))
            for number in (own, own + 1):
                layout = bands.layout(number)
                keys, weak, prefix = layout_keys(u, layout, bands.percent)
                if weak > layout.spare:
                    keys = np.concatenate([keys, prefix])
                held_keys.append(keys)
                held_owners.append(np.full(len(keys), owner[0], np.int64))
                count += len(keys)
            if count >= FLUSH:
                yield flush()
                count = 0
        if held_keys:
            yield flush()

    def gather(batches):
        parts = []
        for b in batches:
            for shared, keys, owners in zip(*(b.column(k) for k in (1, 2, 3)), strict=True):
                pair = np.frombuffer(keys.as_py(), np.int64), np.frombuffer(owners.as_py(), np.int64)
                if shared.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["key", "k1"])
                else:
                    parts.append(pair)
        if not parts:
            return
        keys, owners = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        parts.clear()
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        order = order[np.append(same, False) | np.insert(same, 0, False)]
        keys, owners = keys[order], owners[order]
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])]) if len(keys) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(owners[new])], names=["key", "k1"])

    sent = rows.mapInArrow(send, "bucket int, shared boolean, keys binary, owners binary")
    gathered = sent.repartition(buckets, "bucket").mapInArrow(gather, "key long, k1 long")
    return materialise(gathered, "key-groups")


def sent_sets(pairs: DataFrame, known: DataFrame, rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Of pairs(node, pair), with nodes described in known(node, doc, n, k1, k2): the sets u of the rows(doc, text) with
    their doc ids, with doc, n, k1 and k2; and a written table of each node's doc, n, k1, k2 and under, its pairs."""
    wanted = known.join(pairs.groupBy("node").agg(F.collect_list("pair").alias("under")), "node").select("node", "doc", "n", "k1", "k2", "under")
    wanted = materialise(wanted, "wanted")
    chosen = wanted.select("doc").distinct()
    if wanted.count() <= SENT:
        chosen = F.broadcast(chosen)

    def build(batches):
        for doc, u in _sets(batches, size):
            one, two = digest(u)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int64()) for x in (doc, len(u), one, two)), pa.array([u.astype(np.int64)], pa.list_(pa.int64()))], names=["doc", "n", "k1", "k2", "u"]
            )

    return rows.join(chosen, "doc", "left_semi").mapInArrow(build, "doc long, n long, k1 long, k2 long, u array<long>"), wanted


def fetch_sets(pairs: DataFrame, known: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """node, under (centre, linked) and its set u, for the centres and the nodes of pairs(centre, node, linked) described
    in known(node, doc, n, k1, k2): the rows(doc, text) with their doc ids are read, and of those sets the ones with
    their digests kept. under has the node's pairs, and for a centre itself, so that sets find their centres without
    being dealt by node."""
    both = pairs.select("node", F.struct("centre", "linked").alias("pair")).unionByName(pairs.select(F.col("centre").alias("node"), F.struct("centre", F.lit(False).alias("linked")).alias("pair")).distinct())
    built, wanted = sent_sets(both, known, rows, size)
    found = built.join(wanted, ["doc", "n", "k1", "k2"]).groupBy("doc", "n", "k1", "k2", "node").agg(F.first("under").alias("under"), F.first("u").alias("u"))
    found = materialise(found.select("node", "under", "u"), "pair-sets")
    discard(wanted)
    reclaim(rows.sparkSession)
    return found


def beside_centres(found: DataFrame) -> DataFrame:
    """centre, node, linked, uc (the centre's set) and u (the node's) of the pairs that fetch_sets() got its sets for."""
    centres = found.where(F.exists("under", lambda x: x["centre"] == F.col("node"))).select(F.col("node").alias("centre"), F.col("u").alias("uc"))
    members = found.select("node", F.explode("under").alias("pair"), "u").where("pair.centre <> node")
    return members.select("pair.centre", "node", "pair.linked", "u").join(centres, "centre").select("centre", "node", "linked", "uc", "u")


def links_of(pairs: DataFrame, known: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Those of pairs(a, b) that link. Sizes and parts drop most others, exactly; the sets of the rest are compared."""
    of_a, of_b = (known.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parts").alias(f"p{c}")) for c in "ab")
    sized = pairs.join(of_a, "a").join(of_b, "b").where(F.col("na") * 100 >= F.col("nb") * percent).where(F.col("nb") * 100 >= F.col("na") * percent)
    differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, x: acc + x)
    sized = sized.where((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb")))
    sized = materialise(sized.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.lit(False).alias("linked")), "pairs")
    found = sets(sized)
    shared = F.size(F.array_intersect("uc", "u"))
    out = beside_centres(found).where(100 * shared >= percent * (F.size("uc") + F.size("u") - shared)).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    out = materialise(out, "links")
    discard(sized, found)
    reclaim(known.sparkSession)
    return out


def centre_keys(c: np.ndarray, x: np.ndarray, linked: bool, percent: int) -> list[tuple[str, np.ndarray]]:
    """Elements under which x must meet every set y of the pool of centre c that it links with, unless both link with c.
    A role and elements; what pairs of roles count is said in `pool_groups`.

    Elements outside c come first, then those of c, each by value. Let dx and dy be the differences of x and y from c:
    they share (|dx| + |dy| - |x ^ y|) / 2 elements, and where y does not link with c, |dy| is beyond the bound of a
    link. That gives a least overlap, so the first elements of dx up to it hold a shared one ('linked' and 'apart');
    where only y is apart, that one may stand anywhere in dy ('rest'). Sets far from c meet by the first elements of
    x itself, of which a link leaves at most 100 - percent of 100 unshared ('far'); as differences of linked sets
    from c are close, those near the limit between near and far get both."""
    out, common = [], np.isin(x, c, assume_unique=True)
    own, gone, n, k = x[~common], c[~np.isin(c, x, assume_unique=True)], len(x), len(c)
    difference, limit = len(own) + len(gone), k // 2
    if difference <= limit:
        ordered = np.concatenate([own, gone])
        least = -(-((100 + percent) * difference + (100 - percent) * (k - n) + 1) // (2 * (100 + percent)))
        prefix = difference - least + 1
        out.append(("linked" if linked else "apart", ordered[:prefix]))
        if not linked:
            out.append(("rest", ordered[prefix:]))
    most = (100 - percent) * (n + 100 * n // percent) // (100 + percent)
    if difference > limit - most:
        out.append(("far", np.concatenate([own, x[common]])[: n + (-percent * n // 100) + 1]))
    return out


def hopeful(rows: DataFrame, percent: int) -> DataFrame:
    """centre, node, n of those rows(key, centre, node, component, n, parts) for which their key's group holds a row of
    another component that sizes and parts allow to link. Groups have few members."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "centre", "node", "component", "n", "parts").repartition(partitions, "key").sortWithinPartitions("key")

    def compare(batches):
        held: list[tuple] = []
        out: set[tuple[int, int, int]] = set()

        def close():
            if len(held) > 1:
                component, n = (np.array([r[k] for r in held]) for k in (3, 4))
                parts = np.array([np.asarray(r[5].values) for r in held], np.int16)
                found = np.zeros(len(held), bool)
                for a in range(len(held)):
                    if not found[a]:  # else some row before found it
                        least = np.abs(parts - parts[a]).sum(axis=1, dtype=np.int64)
                        able = (component != component[a]) & ((100 + percent) * least <= (100 - percent) * (n + n[a]))
                        found |= able
                        found[a] = able.any()
                out.update((held[a][1], held[a][2], held[a][4]) for a in np.flatnonzero(found).tolist())
            held.clear()

        def rows_of():
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["centre", "node", "n"])
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            if len(out) > 10_000:
                yield rows_of()
        close()
        yield rows_of()

    return dealt.mapInArrow(compare, "centre long, node long, n long")


def _solved(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join whatever links join among distinct sets, at most one fewer than sets. The first set, which most are
    like, is taken from all: two sets differ where their differences from it do. That is left if it costs more."""
    own = np.repeat(np.arange(len(sets)), sizes := np.array([len(x) for x in sets]))
    elements, at = np.unique(np.concatenate(sets), return_inverse=True)
    of_first = np.zeros(len(elements), bool)
    of_first[at[: sizes[0]]] = True
    df = np.bincount(at, minlength=len(elements)).astype(np.int64)
    if (np.where(of_first, len(sets) - df, df) ** 2).sum() < (df**2).sum():
        # those of the first set that a set lacks, and those it has beyond them
        keep = ~of_first[at]
        lacks = np.ones((len(sets), sizes[0]), bool)
        place = np.cumsum(of_first) - 1
        lacks[own[~keep], place[at[~keep]]] = False
        who, what = np.nonzero(lacks)
        own, at = np.concatenate([own[keep], who]), np.concatenate([at[keep], np.flatnonzero(of_first)[what]])
        order = np.argsort(own, kind="stable")
        own, at = own[order], at[order]
    lengths = np.bincount(own, minlength=len(sets))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    holders = own[np.argsort(at, kind="stable")].astype(np.int32)  # of each element, one after the other
    ends = np.cumsum(np.bincount(at, minlength=len(elements)))
    counts = np.diff(ends, prepend=0)
    label, out, largest = np.arange(len(sets)), [], -1
    for a in range(len(sets)):
        if label[a] == largest:  # what joins it with another component is found from there
            continue
        mine = at[begins[a] : begins[a + 1]]
        each = counts[mine]
        # the holders of all of its elements, one range each
        places = np.arange(each.sum()) + np.repeat(ends[mine] - np.cumsum(each), each)
        differ = lengths + lengths[a] - 2 * np.bincount(holders[places], minlength=len(sets))
        linked = np.flatnonzero(((100 + percent) * differ <= (100 - percent) * (sizes + sizes[a])) & (label != label[a]))
        if len(linked):
            joined, first = np.unique(label[linked], return_index=True)
            out += [(nodes[a], nodes[b]) for b in linked[first].tolist()]
            label[np.isin(label, joined)] = label[a]
        if len(linked) or largest < 0:
            largest = int(np.bincount(label).argmax())
            if (label == largest).all():
                break
    return out


def pool_links(pools: DataFrame, known: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links that join all that links join among each centre and the nodes of its pools(centre, node), which fit in
    memory. The sets are sent once for each centre; known and rows as for fetch_sets()."""
    pairs = pools.select("node", F.col("centre").alias("pair")).unionByName(pools.select(F.col("centre").alias("node"), F.col("centre").alias("pair")).distinct())
    built, wanted = sent_sets(pairs, known, rows, size)
    sent = built.join(wanted, ["doc", "n", "k1", "k2"]).select(F.explode("under").alias("centre"), "node", "u")
    sent = sent.repartition("centre").sortWithinPartitions("centre", F.col("node") != F.col("centre"), "node")

    def solve(batches):
        held: dict[int, np.ndarray] = {}
        last, out = None, []
        for batch in batches:
            for centre, node, u in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2), strict=True):
                if centre != last:
                    if len(held) > 1:
                        out += _solved([*held], [*held.values()], percent)
                    last = centre
                    held.clear()
                held.setdefault(node, np.array(u.values, np.int64))  # rows that repeat a doc_id give a set again
            if len(out) > 10_000:
                yield _link_rows(out)
        if len(held) > 1:
            out += _solved([*held], [*held.values()], percent)
        yield _link_rows(out)

    links = materialise(sent.mapInArrow(solve, "a long, b long").distinct(), "pool-links")
    discard(wanted)
    reclaim(rows.sparkSession)
    return links


def hopeful_parts(rows: DataFrame, percent: int) -> DataFrame:
    """centre, nodes: of those groups of rows(key, centre, node, component, n, parts) the parts that members of different
    components, which sizes and parts allow to link, hold together; of parts with the same members one. Links of a group
    that join components lie in its parts. Groups have few members."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "centre", "node", "component", "n", "parts").repartition(partitions, "key").sortWithinPartitions("key")

    def compare(batches):
        held: list[tuple] = []
        out: dict[tuple[int, ...], int] = {}

        def close():
            if len(held) > 1:
                component, n = (np.array([r[k] for r in held]) for k in (3, 4))
                parts = np.array([np.asarray(r[5].values) for r in held], np.int32)
                part = np.arange(len(held))
                for a in range(len(held)):
                    least = np.abs(parts - parts[a]).sum(axis=1)
                    able = (component != component[a]) & ((100 + percent) * least <= (100 - percent) * (n + n[a]))
                    if able.any():
                        able[a] = True
                        joined = np.unique(part[able])
                        part[np.isin(part, joined)] = joined[0]
                for p in np.flatnonzero(np.bincount(part) > 1).tolist():
                    nodes = tuple(sorted({held[k][2] for k in np.flatnonzero(part == p).tolist()}))
                    out[nodes] = min(held[0][1], out.get(nodes, held[0][1]))
            held.clear()

        def rows_of():
            batch = pa.RecordBatch.from_arrays([pa.array(list(out.values()), pa.int64()), pa.array([list(nodes) for nodes in out], pa.list_(pa.int64()))], names=["centre", "nodes"])
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            if len(out) > 10_000:
                yield rows_of()
        close()
        yield rows_of()

    found = dealt.mapInArrow(compare, "centre long, nodes array<long>").groupBy("nodes").agg(F.min("centre").alias("centre"))
    return materialise(found.select("centre", "nodes"), "parts")


def pool_keys(found: DataFrame, percent: int) -> DataFrame:
    """The pairs (centre, node, linked) that fetch_sets() found with n (size of the node's set), difference (the places of the
    centre's elements that the set lacks, then its elements that the centre lacks), and the keys and roles of centre_keys."""
    joined = beside_centres(found)

    def emit(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[], [], [], [], [], []]
                for centre, node, linked, c, x in zip(*(part.column(k).to_pylist() for k in range(3)), part.column(3), part.column(4), strict=True):
                    c, x = (np.asarray(v.values, np.int64).view(U64) for v in (c, x))
                    salt, keys, roles = mix(np.array([centre], np.int64).view(U64)), [], []
                    for role, elements in centre_keys(c, x, linked, percent):
                        system = U64(0x6A09E667F3BCC908) if role == "far" else U64(0)
                        keys.append(mix(elements ^ mix(salt ^ system)).view(np.int64))
                        roles.append(np.full(len(elements), ROLES.index(role), np.int32))
                    values = centre, node, len(x), np.concatenate([np.flatnonzero(~np.isin(c, x, assume_unique=True)), x[~np.isin(x, c, assume_unique=True)].view(np.int64)]), np.concatenate(keys), np.concatenate(roles)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                lists = [pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), *lists], names=["centre", "node", "n", "difference", "keys", "roles"])

    return materialise(joined.mapInArrow(emit, "centre long, node long, n long, difference array<long>, keys array<long>, roles array<int>"), "pool-keys")


def pool_groups(keyed: DataFrame, component: DataFrame) -> DataFrame:
    """key, centre, node and members (how many) of the groups that pool_keys() makes, without those that hold no pair
    of roles that counts or lie in one component."""
    rows = keyed.select("centre", "node", F.explode(F.arrays_zip("keys", "roles")).alias("k")).select("centre", "node", F.col("k.keys").alias("key"), F.col("k.roles").alias("role"))
    rows = rows.join(component, "node", "left").select("key", "centre", "node", "role", F.coalesce("component", "node").alias("component"))
    count = lambda role: F.count_if(F.col("role") == ROLES.index(role))
    hashes = [F.xxhash64("node", F.lit(k)) for k in range(2)]
    who = [F.bit_xor(F.when(F.col("role") != ROLES.index("rest"), h)).alias(f"some{k}") for k, h in enumerate(hashes)] + [F.bit_xor(h).alias(f"all{k}") for k, h in enumerate(hashes)]
    groups = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), count("linked").alias("linked"), count("apart").alias("apart"), count("rest").alias("rest"), count("far").alias("far"), *who)
    groups = groups.where("low < high").where("far > 1 OR apart > 1 OR (linked > 0 AND apart + rest > 0)")
    # 'rest' is there for linked sets only; of groups with the same members one is enough
    of_linked = lambda a, b: F.when(F.col("linked") > 0, a).otherwise(b)
    groups = groups.select("key", "linked", (F.col("far") + F.col("apart") + F.col("linked") + of_linked(F.col("rest"), 0)).alias("members"), *(of_linked(F.col(f"all{k}"), F.col(f"some{k}")).alias(f"who{k}") for k in range(2)))
    groups = groups.groupBy("members", "who0", "who1").agg(F.min(F.struct("key", "linked")).alias("one")).select("one.key", "one.linked", "members")
    return materialise(rows.join(groups, "key").where((F.col("role") != ROLES.index("rest")) | (F.col("linked") > 0)).select("key", "centre", "node", "members"), "groups")


def _forest(nodes: np.ndarray, sizes: np.ndarray, differences: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join whatever links join in one group, at most one fewer than members. The difference of two sets is
    that of their differences from a common centre."""
    flat = np.concatenate(differences)
    elements, at = np.unique(flat, return_inverse=True)
    own = np.repeat(np.arange(len(nodes)), [len(d) for d in differences])
    shared = np.zeros((len(nodes), len(nodes)), np.float32)
    for low in range(0, len(elements), 8192):
        block = np.zeros((len(nodes), min(8192, len(elements) - low)), np.float32)
        here = (at >= low) & (at < low + 8192)
        block[own[here], at[here] - low] = 1
        shared += block @ block.T
    lengths = np.diag(shared).astype(np.int64)
    apart = lengths[:, None] + lengths - 2 * shared.astype(np.int64)
    top, out = list(range(len(nodes))), []
    for a, b in zip(*np.nonzero(np.triu((100 + percent) * apart <= (100 - percent) * (sizes[:, None] + sizes), 1)), strict=True):
        x, y = int(a), int(b)
        while top[x] != x:
            x = top[x] = top[top[x]]
        while top[y] != y:
            y = top[y] = top[top[y]]
        if x != y:
            top[y] = x
            out.append((int(nodes[a]), int(nodes[b])))
    return out


def _top(tops: dict[int, int], x: int) -> int:
    """The node that stands for x in the groups joined so far."""
    while (up := tops.setdefault(x, x)) != x:
        tops[x] = x = tops[up]
    return x


def _link_rows(out: list[tuple[int, int]]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])
    out.clear()
    return batch


def _links_by_centre(groups: DataFrame, needed: DataFrame, partitions: int, percent: int) -> DataFrame:
    """group_links() of centres whose differences fit in memory: each difference goes to its centre's task once, ahead
    of the groups, and groups that earlier ones joined are passed over."""
    none = lambda t: F.lit(None).cast(t)
    rows = needed.select("centre", F.array("node").alias("nodes"), "n", "difference").unionByName(groups.select("centre", "nodes", none("long").alias("n"), none("array<long>").alias("difference")))
    rows = rows.repartition(partitions, "centre").sortWithinPartitions("centre", F.col("n").isNull())

    def compare(batches):
        last, tops, known = None, {}, {}
        out: list[tuple[int, int]] = []
        for batch in batches:
            for centre, nodes, n, difference in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if centre != last:
                    last, tops, known = centre, {}, {}
                if n is not None:
                    known[nodes[0]] = n, np.asarray(difference.values, np.int64)
                elif len({_top(tops, x) for x in nodes}) > 1:
                    sizes, differences = zip(*(known[x] for x in nodes), strict=True)
                    for a, b in _forest(np.array(nodes), np.array(sizes), list(differences), percent):
                        if _top(tops, a) != _top(tops, b):
                            tops[_top(tops, a)] = _top(tops, b)
                            out.append((a, b))
            if len(out) > 10_000:
                yield _link_rows(out)
        yield _link_rows(out)

    return rows.select("centre", "nodes", "n", "difference").mapInArrow(compare, "a long, b long")


def _links_by_group(groups: DataFrame, needed: DataFrame, partitions: int, percent: int) -> DataFrame:
    """group_links() with every difference sent to every group that holds it."""
    rows = groups.select(F.monotonically_increasing_id().alias("key"), "centre", "nodes")
    rows = rows.select("key", "centre", F.explode("nodes").alias("node")).join(needed, ["centre", "node"])
    rows = rows.select("key", "node", "n", "difference").repartition(partitions, "key").sortWithinPartitions("key", "node")

    def compare(batches):
        held: list[tuple] = []
        out: list[tuple[int, int]] = []

        def close():
            if len(held) > 1:
                _, nodes, sizes, differences = zip(*held, strict=True)
                out.extend(_forest(np.array(nodes), np.array(sizes), [np.asarray(d.values, np.int64) for d in differences], percent))
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            if len(out) > 10_000:
                yield _link_rows(out)
        close()
        yield _link_rows(out)

    return rows.mapInArrow(compare, "a long, b long")


def group_links(groups: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join all that links join inside each of groups(centre, nodes), written tables; nodes are few.
    keyed has the differences from the centres."""
    spark = groups.sparkSession
    # nearly all members are in some group, so the others are sent along rather than joined out
    differences = keyed.select("centre", "node", "n", "difference")
    large = materialise(differences.groupBy("centre").agg(F.sum(F.size("difference") + 20).alias("held")).where(F.col("held") > POOLED).select("centre"), "large")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if large.isEmpty():
        out = _links_by_centre(groups, differences, partitions, percent)
    else:
        by_centre = _links_by_centre(groups.join(large, "centre", "left_anti"), differences.join(large, "centre", "left_anti"), partitions, percent)
        by_group = _links_by_group(groups.join(large, "centre", "left_semi"), differences.join(large, "centre", "left_semi"), partitions, percent)
        out = by_centre.unionByName(by_group)
    out = materialise(out.distinct(), "group-links")
    discard(large)
    return out


def jaccard_join(docs: DataFrame, size: int = 4, percent: int = 85, doc_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: row_id (row_col, if given), doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included),
    kept (true for one row of each component, the first with that doc_id, and for every row that links with nothing).

    Documents link when 100 * |intersection| >= percent * |union| of their sets of `size`-word shingles; a shorter text
    is one shingle of all its words. Shingles are compared by 64-bit hashes and equal sets are told by 128 bits; with
    those, the result is exact. Null and texts without words have empty sets and link with nothing. Rows that repeat a
    doc_id are sets of their own, and each row has its own set's size and component. A row with a null doc_id makes no
    links: it has the component of a document with an equal set, else null. Extra columns are ignored. An empty table gives no rows."""
    spark, bands = docs.sparkSession, Bands(percent)
    texts = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    described = describe_sets(docs.select(row_numbers(row_col).alias("row"), F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text")), size)
    texts = texts.where("doc IS NOT NULL")
    with_set = described.where("n > 0 AND doc IS NOT NULL")
    # a node stands for all equal sets; it is the number of the first row with the least doc_id
    first = F.min_by(F.struct("row", "doc", "parts"), F.struct("doc", "row"))
    known = with_set.groupBy("k1", "k2", "n").agg(first.alias("first")).select(F.col("first.row").alias("node"), F.col("first.doc").alias("doc"), "n", "k1", "k2", "first.parts")
    known = materialise(known, "nodes")
    expected = with_set.agg(F.sum(F.col("n") * (2 * (100 - percent) / (100 + percent)) + 12)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * expected / KEYS_A_BUCKET))
    by_digest = key_groups(texts, size, bands, buckets)
    groups = materialise(by_digest.join(known.select("k1", "node"), "k1").select("key", "node").distinct(), "groups")
    discard(by_digest)
    reclaim(spark)

    def sets(pairs: DataFrame) -> DataFrame:
        return fetch_sets(pairs, known, texts, size)

    component = materialise(known.select("node", F.col("node").alias("component")).limit(0), "component")
    done = None
    while True:
        # groups that lie in one component have nothing left to find
        placed = groups.join(component, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"who{k}") for k in range(2)]
        live = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"), *members).where("low < high")
        # of groups with the same members one is enough
        live = live.groupBy("members", "who0", "who1").agg(F.min("key").alias("key")).select("key", "members")
        members = materialise(groups.join(live, "key"), "members")
        if members.isEmpty():
            break
        # the centre of a group is its member that meets most others: of a flood, what its copies were made from
        meets = members.groupBy("node").agg(F.sum("members").alias("meets"))
        centres = members.join(meets, "node").groupBy("key").agg(F.max_by("node", F.struct("meets", -F.col("node"))).alias("centre"))
        starred = materialise(members.join(centres, "key").select("key", "centre", "node", "members"), "starred")
        # pools: members that can link with another of their group; those of a centre that fit in memory are solved there
        placed = starred.join(component, "node", "left").join(known.select("node", "n", "parts"), "node")
        placed = placed.select("key", "centre", "node", "members", F.coalesce("component", "node").alias("component"), "n", "parts")
        pools = hopeful(placed.where(F.col("members") <= SIFTED), percent).unionByName(placed.where(F.col("members") > SIFTED).select("centre", "node", "n"))
        pools = materialise(pools.where("node <> centre").distinct(), "pools")
        large = materialise(pools.groupBy("centre").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("nodes")).where((F.col("held") > POOLED) | (F.col("nodes") > SOLVED)).select("centre"), "large")
        some_large = not large.isEmpty()
        solved = pool_links(pools.join(large, "centre", "left_anti") if some_large else pools, known, texts, size, percent)
        component = joined_components(component, solved)
        discard(members, pools, solved)
        reclaim(spark)
        if not some_large:
            discard(groups, starred, large)
            break
        centred = materialise(starred.where("node <> centre").join(large, "centre", "left_semi"), "centred")
        discard(starred, large)
        pairs = centred.select("centre", "node").distinct()
        if done is not None:
            pairs = pairs.join(done, ["centre", "node"], "left_anti")
        pairs = materialise(pairs, "stars")
        links = links_of(pairs.select(F.col("centre").alias("a"), F.col("node").alias("b")), known, sets, percent)
        component = joined_components(component, links)
        # pools: members of groups that still lie in several components, under centres that are new to one of them
        placed = centred.join(component, "node", "left").select("key", "centre", "node", "members", F.coalesce("component", "node").alias("component"))
        apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        placed = materialise(placed.join(apart, "key", "left_semi"), "apart")
        few = placed.where(F.col("members") <= SIFTED).join(known.select("node", "n", "parts"), "node")
        pools = hopeful(few, percent).select("centre", "node").unionByName(placed.where(F.col("members") > SIFTED).select("centre", "node")).distinct()
        new_centres = pools.join(pairs, ["centre", "node"], "left_semi").select("centre").distinct()
        linked = links.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.lit(True).alias("linked"))
        if done is not None:
            linked = linked.unionByName(done.where("linked").select("centre", "node", "linked"))
        pools = pools.join(new_centres, "centre", "left_semi").join(linked, ["centre", "node"], "left").select("centre", "node", F.coalesce("linked", F.lit(False)).alias("linked"))
        pools = materialise(pools, "pools")
        pooled = sets(pools)
        keyed = pool_keys(pooled, percent)
        discard(groups, centred, placed, pools, pooled)
        reclaim(spark)
        smaller = pool_groups(keyed, component)
        reclaim(spark)
        few = smaller.where(F.col("members") <= COMPARED).join(component, "node", "left").join(known.select("node", "n", "parts"), "node")
        few = few.select("key", "centre", "node", F.coalesce("component", "node").alias("component"), "n", "parts")
        # differences are sent only for members that can link with another, once for all groups they meet in alike
        able = hopeful_parts(few, percent)
        reclaim(spark)
        found = group_links(able, keyed, percent)
        component = joined_components(component, found)
        following = materialise(smaller.where(F.col("members") > COMPARED).select("key", "node").distinct(), "groups")
        marked = pairs.join(links.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.lit(True).alias("linked")), ["centre", "node"], "left").select("centre", "node", F.coalesce("linked", F.lit(False)).alias("linked"))
        done = materialise(marked if done is None else done.unionByName(marked), "done")
        discard(pairs, links, keyed, smaller, able, found)
        groups = following
        reclaim(spark)

    # the label is the smallest doc_id; of the rows of that set with that doc_id the first is kept
    labelled = known.select("node", "doc").join(component, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    labels = labelled.groupBy("component").agg(F.min("doc").alias("component_id"), F.min_by("node", F.struct("doc", "node")).alias("keeper"))
    of_node = materialise(known.select("node", "k1", "k2", "n").join(labelled.select("node", "component"), "node").join(labels, "component").select("k1", "k2", "n", "component_id", "keeper"), "labels")
    some = described.where("n > 0").select("row", "doc", "n", "k1", "k2").join(of_node, ["k1", "k2", "n"], "left")
    some = some.select(F.col("row").alias("row_id"), F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("row") == F.col("keeper"), F.lit(True)).alias("kept"))
    none = described.where("n = 0").select(F.col("row").alias("row_id"), F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"), F.lit(True).alias("kept"))
    return some.unionByName(none)


def joined_components(component: DataFrame, links: DataFrame) -> DataFrame:
    """component(node, component) with links(a, b) between nodes added. Nodes without a link are not in it."""
    of = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")).distinct()
    merged = components(edges)
    renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("now"))
    kept = component.join(renamed, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return materialise(kept.unionByName(merged).distinct(), "component")


def jaccard_join_query(docs: DataFrame) -> DataFrame:
    """Contract of op10."""
    return jaccard_join(docs).drop("row_id", "kept")


JACCARD_JOIN_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM c JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * i >= 85 * (a.n + b.n - i)
), r(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id GROUP BY ALL
"""
