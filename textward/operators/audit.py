"""Audit records of scans and tamper-evident evidence packages over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.risk import decision

DECISIONS = ["allow", "sanitize", "block", "exception"]
KEPT = ["category", "type", "severity", "confidence", "detector_id", "source", "location"]


def sha256(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def audit_records(scanned: DataFrame, source: str, strictness: str, pattern_version: str, key: Column, batch: Column | None = None, index: Column | None = None, include_evidence: bool = False, reason: Column | None = None, actor: Column | None = None, at: Column | None = None, ml_version: str | None = None) -> DataFrame:
    """One record per scanned row. scan_id is a digest of source, batch, index and key, so a rerun gives the same one;
    evidence is hashed always and kept only if asked for; an exception needs a reason and an actor."""
    null = F.lit(None).cast("string")
    batch, index = (null if batch is None else batch.cast("string")), (F.lit(None).cast("int") if index is None else index.cast("int"))
    both = F.lit(False) if reason is None or actor is None else reason.isNotNull() & actor.isNotNull()
    exception = F.when(both, F.struct((null if reason is None else reason).alias("reason"), (null if actor is None else actor).alias("actor")))
    brief = F.transform("threats", lambda t: F.struct(*[t[c].alias(c) for c in KEPT], sha256(t["evidence"]).alias("evidence_hash"), (t["evidence"] if include_evidence else null).alias("evidence")))
    return scanned.select(
        F.lit("audit-record.v1").alias("schema_version"),
        (F.current_timestamp() if at is None else at).alias("timestamp"),
        F.sha2(F.concat_ws("|", F.lit(source), F.coalesce(batch, F.lit("")), F.coalesce(index.cast("string"), F.lit("")), key.cast("string")), 256).alias("scan_id"),
        batch.alias("batch_id"),
        F.lit(source).alias("source"),
        index.alias("index"),
        F.when(both, "exception").otherwise(decision(F.col("risk_level"))).alias("decision"),
        F.lit(strictness).alias("strictness"),
        F.lit(pattern_version).alias("pattern_db_version"),
        F.lit(ml_version).cast("string").alias("ml_model_version"),
        F.array_distinct(F.transform("threats", lambda t: t["category"])).alias("categories"),
        brief.alias("threats"),
        exception.alias("exception"),
        F.lit(None).cast("double").alias("duration_ms"),
    )


def evidence_package(records: DataFrame, order: str, period_start: str, period_end: str, block: int = 1000) -> DataFrame:
    """One row: counts by decision, detector versions, exceptions in order, whether raw evidence is stored, and a digest
    over the records' JSON in the given order.

    The digest is two-level, so no task holds all records: records are dealt to blocks of consecutive `order` values
    (order div block, longs), each block's JSON lines are hashed in order, and the blocks' hashes are hashed in order."""
    line = F.to_json(F.struct(*sorted(c for c in records.columns if c != order)))
    rows = records.select(F.floor(F.col(order) / block).alias("part"), F.col(order).alias("at"), line.alias("line"), "decision", "scan_id", "pattern_db_version", "ml_model_version", F.exists("threats", lambda t: t["evidence"].isNotNull()).alias("raw"))
    pick = lambda c, test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("at", c)))), lambda s: s[c])
    versions = F.collect_set(F.concat(F.lit("patterns@"), "pattern_db_version"))
    models = F.collect_set(F.concat(F.lit("ml@"), "ml_model_version"))
    counts = [F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS]
    blocks = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *counts, versions.alias("v"), models.alias("m"), F.bool_or("raw").alias("raw"), pick("scan_id", F.col("decision") == "exception").alias("exceptions"), F.sha2(F.array_join(pick("line", F.lit(True)), "\n"), 256).alias("hash"))
    total = blocks.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"),
        F.struct(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DECISIONS]).alias("decision_counts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("v", "m"))))).alias("detector_versions"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "exceptions"))), lambda b: b["exceptions"])).alias("exception_ids"),
        F.coalesce(F.bool_or("raw"), F.lit(False)).alias("raw_content_stored"),
        sha256(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "hash"))), lambda b: b["hash"]), "\n")).alias("package_digest"),
    )
    return total.select(F.lit("audit-evidence-package.v1").alias("schema_version"), F.lit(period_start).alias("period_start"), F.lit(period_end).alias("period_end"), *total.columns)


def verify_package(records: DataFrame, order: str, package: DataFrame) -> bool:
    """True if records still give the package's digest, count and decision counts."""
    now = evidence_package(records, order, "", "").first()
    then = package.first()
    return all(now[c] == then[c] for c in ("package_digest", "record_count", "decision_counts"))
