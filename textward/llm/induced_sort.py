"""Suffix sorting by external induced sorting.

Suffixes are typed, the leftmost small ones are named by sorting their substrings, and if names repeat, the string of
names is sorted first by recursion. Larger, then smaller suffixes are induced from them by two passes over a priority
queue whose entries (first symbol, rank, position) go to sorted runs on disk when they outgrow memory. The text's
types, the names, the substrings to be named beyond `held` and all suffix lists are files as well, mapped or read in
blocks, so memory does not grow with the text. Common-prefix values are taken block by block and capped at the length
asked for.
"""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

#: Queue entries held in memory, and entries read at a time from a run on disk.
IN_MEMORY, READ = 200_000, 20_000
#: Runs on disk that are merged into one, and entries read at a time from each.
FAN, AHEAD = 16, 2_000
#: Symbols or suffixes of a file held at a time.
BLOCK = 1 << 18


class DiskQueue:
    """A min-queue of (symbol, rank, position); beyond `held` entries the largest half becomes a sorted run on disk."""

    def __init__(self, folder: str, held: int = IN_MEMORY):
        self._folder, self._held, self._heap, self._heads, self._runs, self._levels, self._last = folder, held, [], [], {}, {}, 0

    def push(self, entry: tuple[int, int, int]) -> None:
        if len(self._heap) >= self._held:
            self._heap.sort()
            keep = self._held // 2
            self._start(iter(self._heap[keep:]), 0)
            del self._heap[keep:]
        heapq.heappush(self._heap, entry)

    def _start(self, entries: Iterator, level: int) -> None:
        """A new run; where a level has FAN runs, they become one of the next level."""
        with tempfile.NamedTemporaryFile(dir=self._folder, suffix=".run", delete=False) as f:
            while block := list(islice(entries, READ)):
                np.array(block, np.int64).tofile(f)
        self._last += 1
        self._runs[self._last] = self._read(f.name)
        self._levels.setdefault(level, []).append(self._last)
        self._advance(self._last)
        if len(self._levels[level]) >= FAN:
            merged = set(self._levels.pop(level))
            firsts = [(entry, run) for entry, run in self._heads if run in merged]
            self._heads = [(entry, run) for entry, run in self._heads if run not in merged]
            heapq.heapify(self._heads)
            self._start(heapq.merge(*(self._with(entry, self._runs[run]) for entry, run in firsts)), level + 1)
            for run in merged:
                self._runs.pop(run, None)

    @staticmethod
    def _with(entry: tuple, rest: Iterator) -> Iterator[tuple]:
        yield entry
        yield from rest

    @staticmethod
    def _read(path: str) -> Iterator[tuple]:
        with open(path, "rb") as f:
            os.unlink(path)
            while len(block := np.fromfile(f, np.int64, 3 * AHEAD)):
                yield from map(tuple, block.reshape(-1, 3).tolist())

    def _advance(self, run: int) -> None:
        entry = next(self._runs[run], None)
        if entry is not None:
            heapq.heappush(self._heads, (entry, run))

    def peek(self) -> tuple[int, int, int] | None:
        if self._heads and (not self._heap or self._heads[0][0] < self._heap[0]):
            return self._heads[0][0]
        return self._heap[0] if self._heap else None

    def pop(self) -> tuple[int, int, int]:
        if self._heads and (not self._heap or self._heads[0][0] < self._heap[0]):
            entry, run = heapq.heappop(self._heads)
            self._advance(run)
            return entry
        return heapq.heappop(self._heap)


def mapped(folder: str, n: int, kind) -> np.ndarray:
    """n zeros, mapped from a file."""
    if not n:
        return np.zeros(0, kind)
    with tempfile.NamedTemporaryFile(dir=folder, suffix=".map", delete=False) as f:
        f.truncate(n * np.dtype(kind).itemsize)
    out = np.memmap(f.name, kind, "r+")
    os.unlink(f.name)
    return out


def stored(folder: str, blocks: Iterable[np.ndarray], kind=np.int64) -> np.ndarray:
    """The blocks end to end, mapped from a file."""
    with tempfile.NamedTemporaryFile(dir=folder, suffix=".list", delete=False) as f:
        for block in blocks:
            np.asarray(block, kind).tofile(f)
        size = f.tell()
    out = np.memmap(f.name, kind, "r") if size else np.zeros(0, kind)
    os.unlink(f.name)
    return out


def _types(t: np.ndarray, folder: str) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is larger than the empty suffix after it."""
    n = len(t)
    small = mapped(folder, n, bool)
    for at in reversed(range(0, n - 1, BLOCK)):
        stop = min(n - 1, at + BLOCK)
        part = np.asarray(t[at : stop + 1])
        change = np.flatnonzero(part[1:] != part[:-1])
        # each position takes the comparison at the next change of symbol; after the block's last change: as what follows
        nearest = np.searchsorted(change, np.arange(stop - at))
        inside = nearest < len(change)
        here = np.full(stop - at, small[stop])
        first = change[nearest[inside]]
        here[inside] = part[first] < part[first + 1]
        small[at:stop] = here
    return small


def _leftmost(small: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the leftmost small suffixes, block by block."""
    for at in range(1, len(small), BLOCK):
        part = np.asarray(small[at - 1 : at + BLOCK])
        yield np.flatnonzero(part[1:] & ~part[:-1]) + at


def _dumped(folder: str, entries: Iterable) -> str:
    entries = iter(entries)
    with tempfile.NamedTemporaryFile(dir=folder, suffix=".names", delete=False) as f:
        while block := list(islice(entries, AHEAD)):
            pickle.dump(block, f)
    return f.name


def _loaded(path: str) -> Iterator:
    with open(path, "rb") as f:
        os.unlink(path)
        while True:
            try:
                yield from pickle.load(f)
            except EOFError:
                return


def _named(t: np.ndarray, small: np.ndarray, lms: np.ndarray, folder: str, held: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rank of each substring from one leftmost small position to the next (the last one ends with the string), by
    symbols and, of equal symbols, types: larger suffixes come first. The substrings' numbers in that order. How many
    kinds there are. Substrings are sorted as bytes, `held` at a time, and the sorted runs merged."""
    n, m = len(t), len(lms)
    top = max(int(t[at : at + BLOCK].max()) for at in range(0, n, BLOCK))
    kind = np.dtype(">u2" if top < 1 << 15 else ">u8")

    def run(a: int) -> list[tuple[bytes, int]]:
        starts = np.asarray(lms[a : a + held])
        stops = np.append(lms[a + 1 : a + held + 1], [n - 1] if a + held >= m else [])[: len(starts)].astype(np.int64) + 1
        span = slice(int(starts[0]), int(stops[-1]))
        data = (2 * t[span].astype(np.int64) + small[span]).astype(kind).tobytes()
        cuts = zip(((starts - span.start) * kind.itemsize).tolist(), ((stops - span.start) * kind.itemsize).tolist(), strict=True)
        return sorted((data[x:y], i) for i, (x, y) in enumerate(cuts, a))

    if m <= held:
        merged: Iterable = run(0)
    else:
        runs = [_dumped(folder, run(a)) for a in range(0, m, held)]
        while len(runs) > FAN:
            runs = [_dumped(folder, heapq.merge(*map(_loaded, runs[k : k + FAN]))) for k in range(0, len(runs), FAN)]
        merged = heapq.merge(*map(_loaded, runs))
    names, kinds = mapped(folder, m, np.int64), 0
    put = memoryview(names)

    def ranked() -> Iterator[int]:
        nonlocal kinds
        last = None
        for key, i in merged:
            if key != last:
                kinds, last = kinds + 1, key
            put[i] = kinds - 1
            yield i

    order = _spool(folder, ranked())
    return names, order, kinds


def suffix_array(t: np.ndarray, folder: str | None = None, held: int = IN_MEMORY) -> np.ndarray:
    """Positions of the suffixes of t (integers, 0 or more) in order; a suffix precedes those it begins. The result is
    mapped from a file (without a name)."""
    with tempfile.TemporaryDirectory(dir=folder) as own:
        return _sort(t if isinstance(t, np.ndarray) else np.asarray(t, np.int64), own, held)


def _spool(folder: str, values: Iterable[int]) -> np.ndarray:
    """values as an array mapped from a file."""
    values = iter(values)
    return stored(folder, iter(lambda: list(islice(values, READ)), []))


def _values(a: np.ndarray, backwards: bool = False) -> Iterator[int]:
    """The values of an array, a block in memory at a time."""
    for at in range(0, len(a), READ):
        yield from (a[max(0, len(a) - at - READ) : len(a) - at][::-1] if backwards else a[at : at + READ]).tolist()


def _sort(t: np.ndarray, folder: str, held: int) -> np.ndarray:
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = _types(t, folder)
    lms = stored(folder, _leftmost(small))
    if len(lms) > 1:
        names, by_name, kinds = _named(t, small, lms, folder, held)
        if kinds < len(lms):
            by_name = _sort(names, folder, held)
        order = stored(folder, (lms[by_name[at : at + BLOCK]] for at in range(0, len(lms), BLOCK)))
        del names, by_name
    else:
        order = lms
    symbols, is_small = memoryview(t), memoryview(small)

    def larger() -> Iterator[int]:
        queue, rank, seeds = DiskQueue(folder, held), 0, _values(order)
        seed = next(seeds, None)
        queue.push((symbols[n - 1], -1, n - 1))
        while True:
            head = queue.peek()
            if head is not None and (seed is None or head[0] <= symbols[seed]):
                at = queue.pop()[2]
                yield at
            elif seed is not None:
                at, seed = seed, next(seeds, None)
            else:
                return
            if at and not is_small[at - 1]:
                queue.push((symbols[at - 1], rank, at - 1))
            rank += 1

    large = _spool(folder, larger())

    def downwards() -> Iterator[int]:
        queue, rank, seeds = DiskQueue(folder, held), 0, _values(large, backwards=True)
        seed = next(seeds, None)
        while True:
            head = queue.peek()
            if head is not None and (seed is None or -head[0] >= symbols[seed]):
                at = queue.pop()[2]
            elif seed is not None:
                at, seed = seed, next(seeds, None)
            else:
                return
            yield at
            if at and is_small[at - 1]:
                queue.push((-symbols[at - 1], rank, at - 1))
            rank += 1

    return _spool(folder, downwards())[::-1]


def prefix_blocks(t: np.ndarray, sa: np.ndarray, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of sa, and for each suffix in them the symbols it shares with the one before, at most cap; 0 for the
    first."""
    n = len(t)
    for at in range(0, len(sa), BLOCK):
        b = np.asarray(sa[at : at + BLOCK])
        a = np.concatenate([sa[at - 1 : at] if at else [-1], b[:-1]])
        shared, alive = np.zeros(len(b), np.int32), np.flatnonzero(a >= 0)
        for k in range(cap):
            alive = alive[np.maximum(a[alive], b[alive]) + k < n]
            alive = alive[t[a[alive] + k] == t[b[alive] + k]]
            if not len(alive):
                break
            shared[alive] = k + 1
        yield b, shared


def common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """prefix_blocks' second part in one array."""
    return np.concatenate([np.zeros(0, np.int32), *(shared for _, shared in prefix_blocks(t, sa, cap))])


def capped_order(t: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of bytes t at starts by their first `length` bytes, which must lie in t, in memory; and
    where in it a suffix differs from the one before in those. Bytes are compared eight at a time."""
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    words = np.ndarray(len(t) + 1, ">u8", padded.tobytes(), strides=(1,))
    keys = [words[starts + at].astype(np.uint64) >> np.uint64(8 * max(0, 8 - (length - at))) for at in range(0, length, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    return order, new
