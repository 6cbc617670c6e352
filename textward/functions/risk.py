"""Severity ranks, risk levels and decisions as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["low", "medium", "high", "critical"]
LEVELS = ["none", *SEVERITIES]
THRESHOLDS = {"strict": 0.3, "balanced": 0.5, "permissive": 0.7}


def rank(column: Column, names: list[str], first: int = 0) -> Column:
    out = F.lit(None).cast("int")
    for k, name in enumerate(names):
        out = F.when(column == name, F.lit(k + first)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    """1 (low) to 4 (critical)."""
    return rank(severity, SEVERITIES, 1)


def level_rank(level: Column) -> Column:
    """0 (none) to 4 (critical)."""
    return rank(level, LEVELS)


def risk_level(severity: Column, confidence: Column) -> Column:
    """One level up to two down from the severity by confidence (0.8 and more, 0.5 and more, less); none without one."""
    high, mid = confidence >= 0.8, confidence >= 0.5
    return (
        F.when(severity.isNull(), "none")
        .when(severity == "critical", F.when(high, "critical").when(mid, "high").otherwise("medium"))
        .when(severity == "high", F.when(mid, "high").otherwise("medium"))
        .when(severity == "medium", F.when(mid, "medium").otherwise("low"))
        .otherwise("low")
    )


def decision(level: Column, exception_reason: Column | None = None) -> Column:
    out = F.when(level == "none", "allow").when(level.isin("low", "medium"), "sanitize").otherwise("block")
    return out if exception_reason is None else F.when(exception_reason.isNotNull(), "exception").otherwise(out)


def fails(level: Column, threshold: str) -> Column:
    """True where a level reaches the threshold; with 'none' that is always so."""
    return level_rank(level) >= LEVELS.index(threshold)
