import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textward.llm import induced_sort
from textward.llm.induced_sort import DiskQueue, common_prefixes, suffix_array


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.sampled_from([2, 5, 1000]))
def test_suffix_array(values, held):
    t = np.array(values, np.int64)
    sa = suffix_array(t, held=held)
    want = sorted(range(len(values)), key=lambda i: values[i:])
    assert sa.tolist() == want
    for cap in (2, 50):
        lcp = common_prefixes(t, sa, cap)
        for k in range(1, len(want)):
            a, b = values[want[k - 1] :], values[want[k] :]
            n = 0
            while n < min(len(a), len(b), cap) and a[n] == b[n]:
                n += 1
            assert lcp[k] == n


def test_queue_spills(tmp_path):
    rng = np.random.default_rng(0)
    q, seen, out = DiskQueue(str(tmp_path), 10), [], []
    for k in range(500):
        e = (int(rng.integers(0, 50)), k, k)
        q.push(e)
        seen.append(e)
        if k % 7 == 6:
            out.append(q.pop())
            assert out[-1] == min(set(seen) - set(out[:-1]))
    while q.peek():
        out.append(q.pop())
    assert sorted(out) == sorted(seen)


def peak_of_sorting(n, folder):
    t = np.random.default_rng(1).integers(0, 4, n).astype(np.uint8)
    tracemalloc.start()
    try:
        sa = suffix_array(t, str(folder), held=1000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    data = t.tobytes()
    assert len(np.unique(sa)) == n and all(data[a : a + 50] <= data[b : b + 50] for a, b in zip(sa.tolist(), sa[1:].tolist(), strict=False))
    return peak


def test_memory_does_not_grow_with_the_text(tmp_path, monkeypatch):
    for name, value in (("BLOCK", 1000), ("READ", 1000), ("AHEAD", 100)):
        monkeypatch.setattr(induced_sort, name, value, raising=False)
    small, large = (peak_of_sorting(n, tmp_path) for n in (20_000, 120_000))
    assert large < 2 * small
