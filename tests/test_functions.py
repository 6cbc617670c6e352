import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textward.functions.globs import expand_braces, glob_match, match, normalize_path
from textward.functions.regex import to_java
from textward.functions.risk import fails, risk_level
from textward.functions.skeleton import fold, skeleton_of
from textward.sources.patterns import REGISTRY, default_database, fetch, from_json, legacy_database, to_json


@pytest.mark.parametrize(
    "glob,path,want",
    [
        ("data/**/*.json", "data/list.json", True),
        ("data/**/*.json", "./data//users/list.json", True),
        ("logs/*.log", "logs/2026/app.log", False),
        ("**", "a/b/c", True),
        ("**/x", "x", True),
        ("a/**", "a", True),
        ("a/**", "b", False),
        ("src/{a,b/c}.ts", "src/b/c.ts", True),
        ("src/{a,{b,c}}.ts", "src/c.ts", True),
        ("{foo}", "{foo}", True),
        ("[!a]b", "cb", True),
        ("[^a]b", "ab", False),
        ("[a-c]?", "bz", True),
        ("[]]x", "]x", True),
        ("a\\*b", "a*b", True),
        ("a\\*b", "axb", False),
        ("a.b", "axb", False),
        ("[ab", "[ab", True),
        ("A", "a", False),
        ("data/", "data", True),
    ],
)
def test_globs(spark, glob, path, want):
    assert match(glob, path) is want
    row = spark.range(1).select(glob_match(F.lit(path), [glob]).alias("m")).first()
    assert row.m is want


def test_braces_and_paths():
    assert expand_braces("a{b,c{d,e}}") == ["ab", "acd", "ace"]
    assert expand_braces("x{y}z") == ["x{y}z"]
    assert normalize_path("././/a//b/") == "/a/b" or normalize_path("././a//b/") == "a/b"


def test_skeletons():
    assert skeleton_of("ignоrе")[0] == "ignore"
    assert skeleton_of("Αο")[0] == "Ao"
    assert skeleton_of("Ｉｇｎｏｒｅ")[0] == "Ignore"
    assert skeleton_of("\U0001d41a")[0] == "a"
    assert skeleton_of("a\u200bb\u202ec\ufe0f") == ("abc", [0, 2, 4])
    assert skeleton_of("\ufb01x") == ("fix", [0, 0, 1])
    assert fold("\U000e0041") == "\U000e0041"


@given(st.text(alphabet=st.characters(max_codepoint=0x7F)))
def test_ascii_is_its_own_skeleton(text):
    assert skeleton_of(text)[0] == text


def test_regex_translation(spark):
    rows = spark.createDataFrame([("a\u00a0b",), ("éx",), ("x[",), ("a\nb",)], "s string")
    got = [[r[0] for r in rows.select(F.col("s").rlike(to_java(p, "i"))).collect()] for p in (r"a\sb", r"\bx", r"[x[]{2}", r"a[^]b")]
    assert got == [[True, False, False, True], [False, True, True, False], [False, False, True, False], [True, False, False, True]]


@pytest.mark.parametrize("severity,confidence,want", [("critical", 0.8, "critical"), ("critical", 0.5, "high"), ("critical", 0.49, "medium"), ("high", 0.9, "high"), ("high", 0.5, "high"), ("high", 0.3, "medium"), ("medium", 0.5, "medium"), ("medium", 0.4, "low"), ("low", 1.0, "low"), (None, 0.0, "none")])
def test_risk(spark, severity, confidence, want):
    assert spark.range(1).select(risk_level(F.lit(severity).cast("string"), F.lit(confidence))).first()[0] == want


def test_fails(spark):
    row = spark.range(1).select(fails(F.lit("none"), "none"), fails(F.lit("medium"), "high"), fails(F.lit("critical"), "high")).first()
    assert tuple(row) == (True, False, True)


def test_databases(tmp_path):
    db = default_database()
    assert db.size == 101 and [d.id for d in db.detectors] == [r[0] for r in REGISTRY] and db.version == "0.8.0"
    assert len({p.id for d in db.detectors for p in d.patterns}) == 101
    assert legacy_database().size == 47
    again = from_json(to_json(db))
    assert again == db
    for d in db.detectors:
        for p in d.patterns:
            assert not re.fullmatch(r"\s*", p.regex) and 0 < p.confidence <= 1

    class Response:
        status = 200

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self):
            return to_json(db).encode()

    assert fetch("x", lambda url: Response()) == db
    Response.status = 404
    with pytest.raises(OSError):
        fetch("x", lambda url: Response())


def test_required_literals():
    from textward.functions.literals import required

    assert required(r"ignore\s+(?:all\s+)?(?:previous|prior)", "i") == (("ignore",), ("previous", "prior"))
    assert required(r"Key-?ID[0-9]+") == (("key-id", "keyid"),)
    assert required(r"[^]*x{2,}") == (("x",),)
    assert required(r"\s+|abc") == () and required(r"[\u{FE00}]{8,}", "u") == () and required(r"(?:abc)*") == ()


def test_matches_hold_the_required_literals(spark):
    """Every payload that a pattern matches holds a string of each of the pattern's groups."""
    import re

    from textward.functions.literals import required
    from textward.plans.planted import PAYLOADS
    from textward.sources.patterns import default_database, legacy_database

    seen = 0
    for p in [p for db in (default_database(), legacy_database()) for d in db.detectors for p in d.patterns if "u" not in p.flags]:
        regex = re.compile(p.regex.replace("[^]", r"[\s\S]"), re.ASCII | (re.IGNORECASE if "i" in p.flags else 0))
        for text, _ in PAYLOADS:
            for shown in (text, text.upper()):
                if regex.search(shown):
                    seen += 1
                    assert all(any(s in shown.lower() for s in group) for group in required(p.regex, p.flags)), (p.id, shown)
    assert seen > 60


def test_quoted_texts_reach_the_plan_whole(spark):
    from textward.operators.scan import _quoted, _rows
    from textward.sources.patterns import default_database, legacy_database

    texts = [x for db in (default_database(), legacy_database()) for p in _rows(db) for x in (p["java"], *(s for g in p["literals"] for s in g))]
    texts += ["${x}", "\\$\\{", "it's", "\\'", "\\n"]
    row = spark.range(1).selectExpr(f"array({', '.join(map(_quoted, texts))}) AS x").first()
    assert row.x == texts
