import zlib

import numpy as np

from textward.llm.language_id import ByteNetwork, Settings, document_probabilities, identify, position_labels, training_windows, windows_of

QUICK = Settings(sample_windows=1600, steps=150)


def test_gradients_match_differences():
    s = Settings(hidden=3, window=5)
    net = ByteNetwork(["a", "b", "c"], s)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, mask, target = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.ones((5, 4), np.float32), np.array([0, 1, 2, 1])
    mask[3:, 2] = 0
    _, g = net.gradients(x, mask, target)
    for k in net.p:
        i = tuple(rng.integers(0, n) for n in net.p[k].shape) if k[0] != "E" else (2, x[1, 1])
        old, eps = net.p[k][i], 1e-3
        net.p[k][i] = old + eps
        up, _ = net.gradients(x, mask, target)
        net.p[k][i] = old - eps
        down, _ = net.gradients(x, mask, target)
        net.p[k][i] = old
        assert abs((up - down) / (2 * eps) - g[k][i]) < 1e-3, k


def test_scorer_equals_network():
    net = ByteNetwork(["a", "b"], Settings(window=8))
    text = "héllo wörld, this is longer than one window"
    raw = text.encode()
    y = net.positions(np.ascontiguousarray(windows_of(raw, 8).T)).transpose(2, 0, 1).reshape(-1, 2)[: len(raw)].mean(axis=0)
    assert np.allclose(document_probabilities(net.scorer(), [raw, b""], 8), [y, [0, 0]], atol=1e-4)
    assert len(position_labels(net, text, 8)) == len(raw)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = identify(docs, QUICK).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) / len(test) > 0.9


def test_odd_rows(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "12 34 --", "en", 1), (None, "the of", "en", 1), (5, "the of", None, 1), (5, "the of", None, 1)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"), QUICK).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("1", "und"), ("2", "und"), ("3", "und"), ("5", "en"), ("5", "en"), ("None", "en")]
    unlabelled = spark.createDataFrame([(1, "the of", None)], "doc_id long, text string, lang string")
    assert identify(unlabelled, QUICK).first().lang_pred == "und"
    assert identify(unlabelled.limit(0), QUICK).count() == 0


def test_every_language_is_a_class(spark):
    rows = [(k, f"text number {k}", f"l{k % 90:02d}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for windows in (6000, 10):
        assert {lang for lang, _ in training_windows(docs, Settings(sample_windows=windows))} == {r[2] for r in rows}


def test_letters():
    import sys
    import unicodedata

    from textward.llm.language_id import has_letter

    for k in range(0, sys.maxunicode, 7):
        if not 0xD800 <= k < 0xE000:
            assert has_letter(f"1 {chr(k)}_") == (unicodedata.category(chr(k))[0] == "L")
    assert not has_letter("² ① Ⅷ ½ _ 7")


def test_repeated_rows_ties_and_many_languages(spark):
    from textward.llm.language_id import Settings, identify, training_windows

    rows = [(None, "aaa bbb " * 30, "x")] * 500 + [(k, f"text {k} " * 9, f"l{k % 90}") for k in range(300)] + [(9, "² ①", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    s = Settings(sample_windows=400, steps=2)
    sample = training_windows(docs, s)
    # the repeated rows are one document, and every language is there
    usable = {lang for _, _, lang in rows}
    assert len(sample) <= 2 * 400 + 4 * len(usable) and sum(lang == "x" for lang, _ in sample) <= 8
    got = identify(docs, s).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id == 9} >= {"und"}
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id is None}) == 1
