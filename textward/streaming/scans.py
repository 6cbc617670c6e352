"""Scans of streams: the kernel is stateless; conversations keep the tail of their last turn as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scan import scan
from ..operators.sessions import SEPARATOR, straddling
from ..sources.patterns import PatternDatabase

JOINS = "conv string, boundary int, a_end int, b_start int, joined string"


def scan_stream(stream: DataFrame, db: PatternDatabase, text_col: str = "text", **options) -> DataFrame:
    """A stream with the columns of a scan; needs no state and no watermark."""
    return scan(stream, db, text_col, **options)


def boundary_stream(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", window_chars: int = 4000, idle_ms: int | None = 3_600_000) -> DataFrame:
    """Joins of adjacent turns as they arrive. State per conversation: the place of its last turn and at most
    window_chars of its end, dropped after idle_ms (a query with
    that limit keeps triggering; None keeps all state). Turns of one trigger are taken in turn order; a late turn is joined
    with the last one seen."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, tail = state.get if state.exists else (-1, None)
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        out = []
        for text in rows["text"]:
            text = text or ""
            if tail is not None:
                out.append((str(key[0]), seen, len(tail), len(tail) + len(SEPARATOR), tail + SEPARATOR + text[:window_chars]))
            seen, tail = seen + 1, text[-window_chars:]
        state.update((seen, tail or ""))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conv", "boundary", "a_end", "b_start", "joined"])

    keyed = turns.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).alias("turn"), F.col(text_col).alias("text"))
    return keyed.groupBy("conv").applyInPandasWithState(step, JOINS, "seen int, tail string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def cross_turn_stream(turns: DataFrame, db: PatternDatabase, **options) -> DataFrame:
    """conv, boundary and threats that straddle two turns, as turns arrive."""
    keys = {k: options.pop(k) for k in ("conv_col", "turn_col", "text_col", "window_chars", "idle_ms") if k in options}
    scanned = scan(boundary_stream(turns, **keys), db, "joined", **options)
    return scanned.select("conv", "boundary", straddling(F.col("threats"), F.col("a_end"), F.col("b_start")).alias("threats")).where(F.size("threats") > 0)


def threat_rates(scanned: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Scanned rows and threats by window and risk level, late rows up to `late` counted."""
    return scanned.withWatermark(time_col, late).groupBy(F.window(time_col, window), "risk_level").agg(F.count(F.lit(1)).alias("rows"), F.sum("threats_found").alias("threats"))
