"""Measures of detectors and classifiers over labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.risk import rank

SLACK = 1e-9


def share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def judged(samples: DataFrame, detected: str = "detected", expected: str = "expected") -> DataFrame:
    """samples with true positives, misses and false positives as sets of types (null sets count as empty)."""
    empty = F.array().cast("array<string>")
    got, want = F.array_distinct(F.coalesce(F.col(detected), empty)), F.array_distinct(F.coalesce(F.col(expected), empty))
    return samples.withColumns({"tp": F.array_intersect(got, want), "fn": F.array_except(want, got), "fp": F.array_except(got, want)})


def summary(samples: DataFrame, detected: str = "detected", expected: str = "expected") -> DataFrame:
    """One row: adversarial (with an expected type) and benign samples, detection and false-positive rates."""
    j = judged(samples, detected, expected)
    adversarial = F.size(F.coalesce(F.col(expected), F.array().cast("array<string>"))) > 0
    row = j.agg(
        F.count_if(adversarial).alias("adversarial"),
        F.count_if(~adversarial).alias("benign"),
        F.count_if(adversarial & (F.size("tp") > 0)).alias("caught"),
        F.count_if(~adversarial & (F.size("fp") > 0)).alias("false_alarms"),
    )
    return row.withColumns({"detection_rate": share(F.col("caught"), F.col("adversarial")), "false_positive_rate": share(F.col("false_alarms"), F.col("benign"))})


def recall_by_type(samples: DataFrame, detected: str = "detected", expected: str = "expected") -> DataFrame:
    each = judged(samples, detected, expected).select(F.explode(F.array_distinct(F.col(expected))).alias("type"), "tp")
    return each.groupBy("type").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.array_contains("tp", F.col("type"))).alias("caught")).withColumn("recall", share(F.col("caught"), F.col("expected")))


def rate_by_difficulty(samples: DataFrame, difficulty: str = "difficulty", buckets: tuple[str, ...] = ("easy", "moderate", "hard"), detected: str = "detected", expected: str = "expected") -> DataFrame:
    """Detection rate of adversarial samples in each bucket; buckets without samples have rate 0."""
    dims = samples.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    rows = judged(samples, detected, expected).where(F.size(F.col(expected)) > 0).groupBy(F.col(difficulty).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("tp") > 0).alias("caught"))
    out = dims.join(rows, "bucket", "left").na.fill(0, ["n", "caught"])
    return out.withColumn("rate", share(F.col("caught"), F.col("n")))


def mean_confidence(samples: DataFrame, threats: str = "threats", expected: str = "expected") -> DataFrame:
    """Mean confidence of threats of expected types and of others; 0 without one."""
    each = samples.select(F.coalesce(F.col(expected), F.array().cast("array<string>")).alias("want"), F.explode(threats).alias("t")).select(F.array_contains("want", F.col("t.type")).alias("hit"), F.col("t.confidence").alias("c"))
    return each.agg(F.coalesce(F.avg(F.when(F.col("hit"), F.col("c"))), F.lit(0.0)).alias("tp_confidence"), F.coalesce(F.avg(F.when(~F.col("hit"), F.col("c"))), F.lit(0.0)).alias("fp_confidence"))


def gate(summaries: DataFrame, floors: DataFrame) -> DataFrame:
    """Violations of floors(strictness, min_detection, max_fp) by summaries(strictness, adversarial, benign,
    detection_rate, false_positive_rate): strictness and what is wrong. An empty cohort is a violation."""
    j = floors.join(summaries, "strictness", "left")
    problems = F.filter(
        F.array(
            F.when(F.coalesce("adversarial", F.lit(0)) == 0, "no adversarial samples"),
            F.when(F.coalesce("benign", F.lit(0)) == 0, "no benign samples"),
            F.when(F.col("detection_rate") < F.col("min_detection") - SLACK, "detection below floor"),
            F.when(F.col("false_positive_rate") > F.col("max_fp") + SLACK, "false positives above ceiling"),
        ),
        lambda p: p.isNotNull(),
    )
    return j.select("strictness", F.explode(problems).alias("problem"))


SESSION_CLASSES = ["blind-spot", "cumulative", "per-turn"]


def session_class(turn_threats: Column, cross_threats: Column) -> Column:
    return F.when(turn_threats > 0, "per-turn").when(cross_threats > 0, "cumulative").otherwise("blind-spot")


def session_regressions(sessions: DataFrame, expected_col: str = "expected_today") -> DataFrame:
    """Sessions whose class is worse than the one expected."""
    found = sessions.withColumn("found", session_class(F.col("turn_threats"), F.col("cross_turn_threats")))
    return found.where(rank(F.col("found"), SESSION_CLASSES) < rank(F.col(expected_col), SESSION_CLASSES))


def multilabel(scored: DataFrame, labels: list[str], thresholds: list[float], truth: str = "labels", scores: str = "scores") -> DataFrame:
    """Per threshold and label: counts and precision, recall, F1 (0 where undefined). scores is an array in the order
    of labels. One pass: every threshold and label is a counter of one aggregation."""
    pairs = [(t, k) for t in thresholds for k in range(len(labels))]
    hit = lambda t, k: F.get(F.col(scores), k) >= t
    has = lambda k: F.array_contains(truth, labels[k])
    counts = [F.struct(F.lit(float(t)).alias("threshold"), F.lit(labels[k]).alias("label"), F.count_if(hit(t, k) & has(k)).alias("tp"), F.count_if(hit(t, k) & ~has(k)).alias("fp"), F.count_if(~hit(t, k) & has(k)).alias("fn"), F.count_if(~hit(t, k) & ~has(k)).alias("tn")) for t, k in pairs]
    rows = scored.agg(F.array(*counts).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    return with_f1(rows)


def with_f1(rows: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def averages(per_label: DataFrame) -> DataFrame:
    """Macro F1 (mean over labels) and micro F1 (of summed counts) per threshold."""
    sums = per_label.groupBy("threshold").agg(F.avg("f1").alias("macro_f1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return with_f1(sums).select("threshold", "macro_f1", F.col("f1").alias("micro_f1"))
