"""Multi-turn scans: each turn alone, and the joins of adjacent turns, in one pass of the kernel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import SEVERITIES, severity_rank
from ..sources.patterns import PatternDatabase
from .scan import scan

SEPARATOR = "\n"


@dataclass
class SessionScan:
    """turns: one row per turn with its scan. cross_turn: one row per threat that only the join of two turns shows.
    sessions: one row per conversation."""

    turns: DataFrame
    cross_turn: DataFrame
    sessions: DataFrame


def boundaries(turns: DataFrame, conv: str, turn: str, text: str, window_turns: int = 8, window_chars: int = 4000) -> DataFrame:
    """Joins of adjacent turns among the last window_turns: conv, boundary (place of the earlier turn, from 0), a_end,
    b_start and the joined text (the nearest window_chars of either side)."""
    place = Window.partitionBy(conv).orderBy(turn)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(
        F.col(conv),
        (F.row_number().over(place) - 1).alias("boundary"),
        F.count(F.lit(1)).over(Window.partitionBy(conv)).alias("n"),
        F.right(body, F.lit(window_chars)).alias("a"),
        F.left(F.lead(body).over(place), F.lit(window_chars)).alias("b"),
    )
    rows = rows.where(F.col("b").isNotNull() & (F.col("boundary") >= F.greatest(F.lit(0), F.col("n") - window_turns)))
    return rows.select(F.col(conv), "boundary", F.length("a").alias("a_end"), (F.length("a") + len(SEPARATOR)).alias("b_start"), F.concat("a", F.lit(SEPARATOR), "b").alias("joined"))


def straddling(threats: Column, a_end: Column, b_start: Column) -> Column:
    return F.filter(threats, lambda t: t["location"].isNotNull() & (t["location"]["offset"] < a_end) & (t["location"]["offset"] + t["location"]["length"] > b_start))


def scan_sessions(turns: DataFrame, db: PatternDatabase, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", window_turns: int = 8, window_chars: int = 4000, **options) -> SessionScan:
    """Scan conversations. Turns are ordered by turn_col; a null text is an empty turn. With window_turns under 2 there
    are no joins. A cross-turn threat must touch both turns; of several by one detector and type at one place the
    strongest is kept."""
    alone = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.lit(None).cast("int").alias("boundary"), F.lit(None).cast("int").alias("a_end"), F.lit(None).cast("int").alias("b_start"), F.col(text_col).alias("body"))
    joined = boundaries(turns, conv_col, turn_col, text_col, window_turns, window_chars)
    pairs = joined.select(F.col(conv_col).alias("conv"), F.lit(None).cast(turns.schema[turn_col].dataType).alias("turn"), "boundary", "a_end", "b_start", F.col("joined").alias("body"))
    both = scan(alone.unionByName(pairs), db, "body", **options)

    of_turns = both.where("boundary IS NULL").drop("boundary", "a_end", "b_start")
    of_joins = both.where("boundary IS NOT NULL").withColumn("threats", straddling(F.col("threats"), F.col("a_end"), F.col("b_start")))
    found = of_joins.select("conv", "boundary", F.posexplode("threats").alias("position", "threat"))
    first = Window.partitionBy("conv", "boundary", "threat.detector_id", "threat.type", "threat.location.offset").orderBy("position")
    cross = found.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(
        "conv",
        "boundary",
        "position",
        *[F.col(f"threat.{c}").alias(c) for c in ("category", "type", "severity", "confidence", "description", "evidence", "detector_id", "pattern_id", "source")],
        F.array(F.col("boundary"), F.col("boundary") + 1).alias("contributing_turns"),
        F.col("threat.confidence").alias("accumulated_confidence"),
    )
    per_turn = of_turns.groupBy("conv").agg(F.count(F.lit(1)).alias("turns"), F.sum("threats_found").cast("long").alias("turn_threats"), F.max(severity_rank(F.col("highest_severity"))).alias("turn_rank"))
    per_join = of_joins.groupBy("conv").agg(F.sum(F.length("body")).alias("window_chars"))
    per_cross = cross.groupBy("conv").agg(F.count(F.lit(1)).alias("cross_turn_threats"), F.max(severity_rank(F.col("severity"))).alias("cross_rank"))
    top = F.greatest(F.coalesce("turn_rank", F.lit(0)), F.coalesce("cross_rank", F.lit(0)))
    sessions = (
        per_turn.join(per_join, "conv", "left")
        .join(per_cross, "conv", "left")
        .select(
            "conv",
            "turns",
            "turn_threats",
            F.coalesce("cross_turn_threats", F.lit(0)).alias("cross_turn_threats"),
            F.coalesce("window_chars", F.lit(0)).alias("window_chars"),
            ((F.col("turn_threats") == 0) & F.col("cross_turn_threats").isNull()).alias("clean"),
            F.get(F.array(*map(F.lit, SEVERITIES)), top - 1).alias("highest_severity"),
        )
    )
    return SessionScan(of_turns, cross, sessions)


def trailing_window(turns: DataFrame, conv: str, turn: str, text: str, window_turns: int = 8, window_chars: int = 4000) -> DataFrame:
    """The last turns of each conversation that fit window_chars with separators and window_turns, at least the last:
    conv, first (place of the first turn in it), n, joined. Conversations of one turn are left out."""
    newest = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    body = F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(
        F.col(conv),
        body.alias("body"),
        F.row_number().over(newest).alias("back"),
        F.count(F.lit(1)).over(Window.partitionBy(conv)).alias("total"),
        F.sum(F.length(body)).over(newest.rowsBetween(Window.unboundedPreceding, 0)).alias("chars"),
    )
    fits = (F.col("back") == 1) | ((F.col("chars") + F.col("back") - 1 <= window_chars) & (F.col("back") <= window_turns))
    kept = rows.where(fits & (F.col("total") > 1)).groupBy(conv).agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "body"))).alias("parts"))
    return kept.select(conv, (F.col("total") - F.col("n")).alias("first"), "n", F.array_join(F.transform("parts", lambda p: p["body"]), SEPARATOR).alias("joined"))


def accumulated(windows: DataFrame, per_turn_types: DataFrame, labels: DataFrame, conv: str) -> DataFrame:
    """Labels(conv, type, confidence) of trailing windows that no single turn of the conversation had."""
    types = labels.where(F.col("type").isin("latent-memory-poisoning", "contextual-learning-trap"))
    return types.join(per_turn_types.select(conv, "type").distinct(), [conv, "type"], "left_anti").join(windows.select(conv, "first", "n"), conv).withColumn("contributing_turns", F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).drop("first", "n")
