"""The scan kernel: pattern matches of a text as an array of threats on its own row.

Everything stays in the row, so a scan adds no shuffle: a stage of substring tests and literal regular expressions says
which patterns occur, and only those are searched again for spans, gated, ordered and spliced out. The pattern table is one literal.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import required
from ..functions.regex import SPACES, to_java
from ..functions.risk import SEVERITIES, THRESHOLDS, risk_level, severity_rank
from ..functions.skeleton import original_span, skeleton
from ..sources.patterns import PatternDatabase

TABLE = "array<struct<detector:string,det_ord:int,pat_ord:int,id:string,java:string,category:string,type:string,severity:string,raised:string,confidence:double,boosted:double,label:string,group:int,least:int,boost:boolean,require:boolean,drop_below:double,raw:boolean,masked:boolean,mode:string,replacement:string,signals:string,suffix:string,plain_suffix:string>>"
KEPT = 200


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{SPACES}]+|[{SPACES}]+$", "")


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _rows(db: PatternDatabase) -> list[dict]:
    out = []
    for det_ord, d in enumerate(db.detectors):
        raised = dict(d.raise_to)
        for p in d.patterns:
            out.append(
                {
                    "detector": d.id, "det_ord": det_ord, "pat_ord": len(out), "id": p.id, "java": to_java(p.regex, p.flags), "category": p.category, "type": p.type,
                    "severity": p.severity, "raised": raised.get(p.severity, p.severity), "confidence": p.confidence, "boosted": min(1.0, p.confidence + d.boost), "label": p.label,
                    "group": p.extract_group, "least": p.min_length, "boost": p.boost, "require": p.require, "drop_below": d.drop_below, "raw": d.raw, "masked": d.masked,
                    "literals": required(p.regex, p.flags), "mode": d.mode, "replacement": d.replacement if d.mode == "replace" else "", "signals": to_java(d.signals, "i") if d.signals else r"(?!)", "suffix": d.suffix, "plain_suffix": d.plain_suffix,
                }
            )
    return out


def shortened(x: Column) -> Column:
    return F.when(F.length(x) > KEPT, F.concat(F.left(x, F.lit(KEPT - 3)), F.lit("..."))).otherwise(x)


def redacted(x: Column) -> Column:
    t = trim(x)
    return F.when(F.length(t) <= 4, "[REDACTED]").otherwise(F.concat(F.left(t, F.lit(4)), F.lit("[REDACTED "), F.length(t).cast("string"), F.lit(" chars]")))


def _spans(x: Column, p: Column) -> Column:
    """offset, matched, extracted and number of every match of pattern row p in x, by the gaps between matches."""

    def placed(f: Column) -> Column:
        start = F.struct(F.lit(0).alias("stop"), F.array().cast("array<struct<offset:int,matched:string,extracted:string,at:int>>").alias("out"))

        def step(acc: Column, m: Column) -> Column:
            i = F.size(acc["out"])
            offset = acc["stop"] + F.length(F.get(f["gaps"], i))
            span = F.struct(offset.alias("offset"), m.alias("matched"), F.when(p["group"] == 0, m).otherwise(F.get(f["groups"], i)).alias("extracted"), i.alias("at"))
            return F.struct((offset + F.length(m)).alias("stop"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(f["whole"], start, step, lambda acc: acc["out"])

    groups = F.when(p["group"] > 0, F.regexp_extract_all(x, p["java"], p["group"]))
    return let(F.struct(F.regexp_extract_all(x, p["java"], F.lit(0)).alias("whole"), F.split(x, p["java"], -1).alias("gaps"), groups.alias("groups")), placed)


def _gated(spans: Column, p: Column, threshold: float) -> Column:
    """Spans that pass the length, signal and confidence gates, with severity, confidence and signal."""

    def judged(s: Column) -> Column:
        t = trim(s["extracted"])
        return F.struct(s["offset"].alias("offset"), s["matched"].alias("matched"), s["at"].alias("at"), (F.length(t) >= p["least"]).alias("long"), F.rlike(t, p["signals"]).alias("signal"))

    def shaped(s: Column) -> Column:
        up = p["boost"] & s["signal"]
        return F.struct(
            s["offset"].alias("offset"),
            s["matched"].alias("matched"),
            s["at"].alias("at"),
            F.when(up, p["raised"]).otherwise(p["severity"]).alias("severity"),
            F.when(up, p["boosted"]).otherwise(p["confidence"]).alias("confidence"),
            F.concat(p["label"], F.when(s["signal"], p["suffix"]).otherwise(p["plain_suffix"])).alias("description"),
        )

    passing = F.filter(F.transform(spans, judged), lambda s: s["long"] & ~(p["require"] & ~s["signal"]) & ~(p["boost"] & ~s["signal"] & (p["confidence"] < p["drop_below"])))
    return F.filter(F.transform(passing, shaped), lambda s: s["confidence"] >= threshold)


def _quoted(x: str) -> str:
    """x as a string of SQL text; '$' is escaped too, as '${' would be taken for a variable."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def _occurring(patterns: list[dict]) -> Column:
    """Numbers of the patterns that match: the literals their matches hold are looked for first, in the lower-cased
    text. One SQL text, as building thousands of columns one by one takes seconds."""
    tests = []
    for p in patterns:
        lower, text = ("_lower", "_text") if p["raw"] else ("_searched_lower", "_searched")
        groups = ["(" + " OR ".join(f"contains({lower}, {_quoted(s)})" for s in group) + ")" for group in p["literals"]]
        tests.append(f"CASE WHEN {' AND '.join([*groups, f'rlike({text}, {_quoted(p["java"])})'])} THEN {p['pat_ord']} END")
    return F.expr(f"filter(array({', '.join(tests)}), h -> h IS NOT NULL)") if tests else F.array().cast("array<int>")


def _threats(text: Column, searched: Column, places: Column, hits: Column, table: Column, threshold: float) -> Column:
    """All threats in order: severity, confidence, then registry, pattern and place; with what sanitising needs."""

    def of_pattern(p: Column) -> Column:
        x = F.when(p["raw"], text).otherwise(searched)
        folded = ~p["raw"] & places.isNotNull()

        def threat(s: Column) -> Column:
            n = F.length(s["matched"])
            where = F.when(folded, original_span(places, F.length(text), s["offset"], n)).otherwise(F.struct(s["offset"].alias("offset"), n.alias("length")))

            def full(at: Column) -> Column:
                shown = F.when(folded, F.substring(text, at["offset"] + 1, at["length"])).otherwise(s["matched"])
                return F.struct(
                    F.struct((-severity_rank(s["severity"])).alias("severity"), (-s["confidence"]).alias("confidence"), p["det_ord"].alias("det"), p["pat_ord"].alias("pat"), s["at"].alias("at")).alias("order"),
                    p["category"].alias("category"),
                    p["type"].alias("type"),
                    s["severity"].alias("severity"),
                    F.round(s["confidence"], 4).alias("confidence"),
                    s["description"].alias("description"),
                    F.when(p["masked"], redacted(shown)).otherwise(shortened(shown)).alias("evidence"),
                    at.alias("location"),
                    p["detector"].alias("detector_id"),
                    p["id"].alias("pattern_id"),
                    F.lit("pattern").alias("source"),
                    p["mode"].alias("mode"),
                    F.when(p["mode"] == "blank", F.regexp_replace(s["matched"], r"""=\s*["'][^"']*["']""", '=""')).otherwise(p["replacement"]).alias("put"),
                )

            return let(where, full)

        return F.transform(_gated(_spans(x, p), p, threshold), threat)

    return F.array_sort(F.flatten(F.transform(hits, lambda h: let(F.get(table, h), of_pattern))))


def merged_text(text: Column, threats: Column) -> Column:
    """text with every span of a sanitising detector replaced once, on its original places; overlapping spans are one
    and take the first one's replacement."""
    spans = F.array_sort(F.transform(F.filter(threats, lambda t: t["mode"] != "none"), lambda t: F.struct(t["location"]["offset"].alias("start"), t["order"]["det"].alias("det"), (t["location"]["offset"] + t["location"]["length"]).alias("stop"), t["put"].alias("put"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] >= acc["at"], F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["put"]).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))
        )

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sequential_text(text: Column, threats: Column) -> Column:
    """text spliced detector after detector, last span first, each at its original offset in what is left so far: parity
    with engines that do so, drift included."""
    spans = F.array_sort(F.transform(F.filter(threats, lambda t: t["mode"] != "none"), lambda t: F.struct(t["order"]["det"].alias("det"), (-t["location"]["offset"]).alias("start"), t["order"].alias("order"), t["location"]["length"].alias("n"), t["put"].alias("put"))))
    return F.aggregate(spans, text, lambda acc, s: F.concat(F.left(acc, -s["start"]), s["put"], F.substring(acc, -s["start"] + s["n"] + 1, F.length(acc))))


PUBLIC = ["category", "type", "severity", "confidence", "description", "evidence", "location", "detector_id", "pattern_id", "source"]


def scan(df: DataFrame, db: PatternDatabase, text_col: str = "text", strictness: str = "balanced", normalize: bool = True, sanitize_mode: str = "merged") -> DataFrame:
    """df with threats, clean, sanitized, risk_level, threats_found, detectors_run and highest_severity.

    Null text counts as empty. Detectors that are not raw search the skeleton of texts that have one; spans and evidence
    refer to the original text. No row is added, dropped or moved."""
    patterns = _rows(db)
    original = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumn("_text", original)
    if normalize:
        rows = rows.withColumn("_folded", skeleton(F.col("_text"))).withColumn("_searched", F.coalesce("_folded.skeleton", "_text")).withColumn("_places", F.col("_folded.places")).drop("_folded")
    else:
        rows = rows.withColumn("_searched", F.col("_text")).withColumn("_places", F.lit(None).cast("array<int>"))
    rows = rows.withColumn("_lower", F.lower("_text")).withColumn("_searched_lower", F.when(F.col("_places").isNull(), F.col("_lower")).otherwise(F.lower("_searched")))
    rows = rows.withColumn("_hits", _occurring(patterns))
    table = F.from_json(F.lit(json.dumps(patterns)), TABLE)
    full = F.when(F.size("_hits") > 0, _threats(F.col("_text"), F.col("_searched"), F.col("_places"), F.col("_hits"), table, THRESHOLDS[strictness]))
    rows = rows.withColumn("_full", full)
    clean = F.size(F.coalesce("_full", F.array().cast(rows.schema["_full"].dataType))) == 0
    spliced = (merged_text if sanitize_mode == "merged" else sequential_text)(F.col("_text"), F.col("_full"))
    first = F.get("_full", F.lit(0))
    public = F.transform("_full", lambda t: F.struct(*[t[c].alias(c) for c in PUBLIC]))
    empty = F.array().cast("array<struct<category:string,type:string,severity:string,confidence:double,description:string,evidence:string,location:struct<offset:int,length:int>,detector_id:string,pattern_id:string,source:string>>")
    out = rows.withColumns(
        {
            "threats": F.coalesce(public, empty),
            "clean": clean,
            "sanitized": F.when(clean, F.col("_text")).otherwise(spliced),
            "risk_level": risk_level(first["severity"], first["confidence"]),
            "threats_found": F.when(clean, 0).otherwise(F.size("_full")),
            "detectors_run": F.lit(len(db.detectors)),
            "highest_severity": first["severity"],
        }
    )
    return out.drop("_text", "_searched", "_lower", "_searched_lower", "_places", "_hits", "_full")


def threats(scanned: DataFrame, *keys: str) -> DataFrame:
    """One row per threat of a scan: keys, position in the scan's order, and the threat's fields.

    A plain posexplode() would have the optimizer infer a filter on the array's size and push it below the scan, which
    would then run several times a row."""
    return scanned.select(*keys, F.posexplode_outer("threats").alias("position", "threat")).where("position IS NOT NULL").select(*keys, "position", "threat.*")


assert SEVERITIES == ["low", "medium", "high", "critical"]
