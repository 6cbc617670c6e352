import hashlib
import random

import pytest

from textward.llm.suffix_dedup import suffix_dedup


def brute(rows, length):
    first: dict = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < doc:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcdé ", k=rng.choice([20, 49, 50, 51, 60, 120, 300]))) for _ in range(12)]
    rows = []
    for d in range(90):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("abcdé ", k=rng.randrange(80))) for _ in range(rng.randrange(6)))
        rows.append((d * 3 - 20, text))
    whole = passages[0] * 3
    return rows + [(500, whole), (501, whole), (502, "a" * 400), (503, "b" + "a" * 300), (504, None), (505, ""), (506, whole[:55] + "x" + whole[56:])]


@pytest.mark.parametrize("seed,length,anchor", [(1, 50, 24), (2, 20, 9), (3, 50, 50)])
def test_equals_brute_force(spark, seed, length, anchor):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, doc int").repartition(4)
    got = sorted(tuple(r)[:5] for r in suffix_dedup(docs, length, anchor).collect())
    assert got == brute(rows, length)


def test_long_text_in_parts(spark, monkeypatch):
    import textward.llm.suffix_dedup as m

    rng = random.Random(5)
    text = "".join(rng.choices("abcdefgh ", k=9000))
    rows = [(1, text), (2, text[100:8000] + "?" + text[3000:3400])]
    monkeypatch.setattr(m, "BLOCK", 1000)
    batches = m._blocks(iter([__import__("pyarrow").RecordBatch.from_pylist([{"doc": 1, "tag": 7, "text": text}])]), 50)
    assert len(list(batches)) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:5] for r in suffix_dedup(docs).collect()) == brute(rows, 50)


def test_odd_rows(spark):
    schema = "doc_id long, text string, start int, kind int"
    assert suffix_dedup(spark.createDataFrame([], schema)).count() == 0
    same = "the same words over and over, more than fifty bytes of them, and then some"
    rows = [(None, same, 0, 0), (1, same, 0, 0), (1, same, 0, 0), (2, same, 0, 0)]
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, len(same)), (None, 0)]


def test_rows_that_repeat_an_id_are_cut_each_at_their_places(spark):
    rng = random.Random(9)
    a, b = ("".join(rng.choices("abcdefghij ", k=120)) for _ in range(2))
    rows = [(1, a), (2, a), (2, b), (3, b[:70] + a[30:100])]
    got = sorted(tuple(r)[:5] for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows, 50) and [r[2] for r in got if r[0] == 2] in ([0, 120], [120, 0])


def test_anchors_with_few_bytes_are_sorted_in_memory(monkeypatch):
    import textward.llm.suffix_dedup as m

    rng, length = random.Random(8), 50
    rows = []
    for anchor in range(40):
        core = bytes(rng.choices(b"abc\xc3\xa9", k=44))
        rows += [(anchor, k, rng.randrange(1000), (b"xy" if k % 2 else b"zy")[: k % 3] + core + bytes(rng.choices(b"ab", k=rng.randrange(14)))) for k in range(30)]
    least: dict = {}
    for anchor, _, doc, text in rows:
        for i in range(len(text) - length + 1):
            s = anchor, text[i : i + length]
            least[s] = min(least.get(s, doc), doc)
    expected = {(anchor, k, i): least[anchor, text[i : i + length]] for anchor, k, _, text in rows for i in range(len(text) - length + 1)}

    def found():
        runs = [run for columns in m.sort_by_anchor(iter(rows), length) for run in zip(*(c.tolist() for c in columns), strict=True)]
        assert all(r[4] != s[4] or r[:2] != s[:2] for r, s in zip(runs, runs[1:]))  # runs are as long as can be
        places = [((a, c, i), doc) for a, c, begin, stop, doc in runs for i in range(begin, stop)]
        assert len(places) == len(dict(places))
        return dict(places)

    monkeypatch.setattr(m, "HELD", 5000)
    with monkeypatch.context() as no_disk:
        no_disk.setattr(m, "suffix_array", None)
        assert found() == expected
    monkeypatch.setattr(m, "HELD", 500)  # an anchor has more, so each is sorted on disk
    assert found() == expected
    assert [len(c) for c in m.sort_held([(1, 2, 3, b"short")], length)] == [0] * 5
