"""Exact dedup, quality rules, license scan and mixing on small tables: odd rows, and parameters that bite."""

import hashlib
import math

import pytest

from textward.llm.exact_dedup import DigestIndex, digests, exact_dedup
from textward.llm.license_scan import license_scan
from textward.llm.mixing import exponent_for_entropy, exponent_for_repeats, mix, mixed
from textward.llm.quality_rules import quality_rules
from textward.llm.shared import scratch

SCHEMA = "doc_id long, text string, source string, digest int, block int"
ODD = [(1, None, None, 0, 0), (2, "", "s", 0, 0), (3, " \n\x0b", "s", 0, 0), (4, "a b", "s", 0, 0), (4, "a b", "s", 0, 0), (None, "ab ", "s", 0, 0), (5, "A B", "s", 0, 0), (6, "x " * 30000, "t", 0, 0)]


def test_exact_dedup(spark):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(ODD, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 4, 3, True), (4, 4, 3, False), (None, 4, 3, False), (5, 5, 1, True), (6, 6, 1, True)], key=str)
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_groups_are_broadcast_and_the_same(spark):
    rows = [(k, "copy" if k % 2 else f"t{k}", "s", 0, 0) for k in range(400)]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all((r.group_size, r.keep_id) == ((200, 1) if r.doc_id % 2 else (1, r.doc_id)) for r in got) and len(got) == 400


def test_index_persists_and_appends(spark):
    path = scratch(spark, "index")
    first = DigestIndex(spark, path, 4)
    first.ingest(digests(spark.createDataFrame([(1, "a", "s", 0, 0), (2, "b", "s", 0, 0)], SCHEMA)))
    batch = digests(spark.createDataFrame([(3, "a ", "s", 0, 0), (4, "c", "s", 0, 0)], SCHEMA))
    again = DigestIndex(spark, path, 4)
    spark.sql(f"REFRESH TABLE {again.table}")
    for _ in range(2):
        again.ingest(batch)
    assert sorted(r.keep_id for r in again.rows().collect()) == [1, 2, 4]


def test_quality_rules(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(ODD, SCHEMA)).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[6].n_words == 30000 and got[6].n_repeat_words == 30000 and got[6].base_failed
    body = "\n".join(f"line {k} of a text with words" for k in range(3))
    one = quality_rules(spark.createDataFrame([(1, body + "\n" + body + "\n#$\n \n", "s", 0, 0)], SCHEMA)).first()
    assert (one.n_words, one.n_symbols, one.n_dup_lines, one.n_repeat_words) == (43, 2, 3, 42)


def test_boilerplate_is_removed_and_depleted_documents_go(spark):
    own = lambda k: " ".join("own" + "".join(chr(97 + x) for x in (k // 26, k % 26, i // 26, i % 26)) for i in range(60))
    menu = "Home  About 12 Contact " + " ".join(f"item{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    rows = [(k, f"{own(k)}\n{menu if k % 2 else menu.lower().replace('12', '7')}", "site", 0, 0) for k in range(40)]
    rows += [(100, f"{menu}\ntail", "site", 0, 0), (101, f"{menu}\ntail", "other", 0, 0)]
    rows += [(200 + k, own(600), "site", 0, 0) for k in range(40)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA), least_documents=10, with_text=True).collect()}
    assert all(got[k].kept and got[k].clean_text == own(k) for k in range(40))
    assert not got[100].kept and not got[100].base_failed and got[100].clean_text == "tail"
    assert got[101].boilerplate_chars == 0
    # copies of one text are one document, so their lines are not boilerplate
    assert all(got[200 + k].kept for k in range(40))


def test_lines_are_counted_by_documents_not_by_their_smallest_hash(spark):
    key = lambda line: hashlib.md5(line.encode()).hexdigest()[:15]
    letters = lambda k: "".join(chr(97 + int(c)) for c in f"{k:06d}")
    own = [f"only here {letters(k)} " + " ".join(f"w{letters(100 * k + i)}" for i in range(60)) for k in range(30)]
    # a shared line whose hash is below that of every own line
    menu = next(m for m in (f"menu {letters(k)}" for k in range(10**6)) if key(m) < min(map(key, own)))
    docs = spark.createDataFrame([(k, f"{menu}\n{x}", "site", 0, 0) for k, x in enumerate(own)], SCHEMA)
    assert {r.boilerplate_chars for r in quality_rules(docs).collect()} == {len(menu)}
    # 100 copies are one document of the host, too: 30 of 31 hold the shared line
    copies = spark.createDataFrame([(1000 + k, "word " * 60, "site", 0, 0) for k in range(100)], SCHEMA)
    got = quality_rules(docs.unionByName(copies), host_share=0.5).collect()
    assert all(r.boilerplate_chars == (len(menu) if r.doc_id < 1000 else 0) for r in got)


def test_license_scan(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    rows = [*ODD, (10, "The MIT-license. General Public LICENSE; mit license", "s", 0, 0), (11, notice.replace("free of charge", "wholly free of charge"), "s", 0, 0), (12, "mit.\nApache  License x general public notice", "s", 0, 0), (13, "éMIT license", "s", 0, 0)]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[10].n_base, got[10].first_word, got[10].last_word, got[10].base_labels) == (3, 1, 6, "gpl,mit")
    assert got[11].n_base == 0 and got[11].base_labels == "" and got[11].labels == "mit" and 0.8 <= got[11].score <= 1
    assert (got[12].base_labels, got[12].first_word) == ("apache", 1)
    assert got[13].n_base == 0 and got[13].n_words == 2 and got[1].n_words == 0 and got[6].n_words == 30000
    assert license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exponents(spark):
    assert exponent_for_repeats(100, 10, 10) == 0 and abs(exponent_for_repeats(100, 10, 10**0.5) - 0.5) < 1e-9
    assert exponent_for_repeats(5, 5, 1) == 0 and abs(exponent_for_repeats(100, 10, 1) - 1) < 1e-9
    totals = spark.createDataFrame([("a", 100), ("b", 10), ("c", 0)], "source string, tokens long")
    e = exponent_for_entropy(totals, 0.6)
    w = [100**e, 10**e]
    assert abs(-sum(x / sum(w) * math.log(x / sum(w)) for x in w) - 0.6) < 1e-6


@pytest.mark.parametrize("limit", [1.0, 1.5, 4.0])
def test_mixing(spark, limit):
    rows = [(k, "w " * (k % 7), "big", 0, 0) for k in range(300)] + [(1000 + k, "w " * (k % 5 + 1), "small", 0, 0) for k in range(40)] + [(2000, None, None, 0, 0)]
    got = {r.doc_id: r for r in mix(spark.createDataFrame(rows, SCHEMA), max_repeats=limit).collect()}
    drawn = lambda s: sum(r.n_tokens * r.copies for r in got.values() if r.source == s)
    big, small = (sum(r.n_tokens for r in got.values() if r.source == s) for s in ("big", "small"))
    assert drawn("big") == big and got[2000].copies == 1
    want = small * min(limit, big / small)
    assert want - 5 <= drawn("small") <= want + 1
    assert {round(r.weight, 6) for r in got.values() if r.source == "small"} == {round(want / (want + big), 6)} or abs([r.weight for r in got.values() if r.source == "small"][0] - want / (want + big)) < 1e-3


def test_mixed_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = mixed(docs).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ODD} and got[0].__fields__[:5] == ["doc_id", "text", "source", "digest", "block"]
    assert mixed(docs.limit(0)).count() == 0
    assert len(got) >= len(ODD)
    with pytest.raises(ValueError):
        mixed(docs.withColumnRenamed("block", "mix_pass"))


def test_rarely_shared_smallest_hash(spark):
    """12 hosts of 200 pages, each with the host's menu of 20 lines and one line of its own: the menus go from every page."""
    letters = lambda k: "".join(chr(97 + int(c)) for c in f"{k:04d}")
    rows = []
    for h in range(12):
        menu = "\n".join(f"entry {letters(k)} of {letters(h)}" for k in range(20))
        rows += [(1000 * h + k, f"{menu}\nown {letters(h)} {letters(k)}", f"h{h}", 0, 0) for k in range(200)]
    got = quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 2400 and all(r.removed_lines == 20 and r.boilerplate_chars == 20 * len("entry aaaa of aaaa") for r in got)
