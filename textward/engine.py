"""The engine's public face: configured once, lazy DataFrames in and out."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.risk import THRESHOLDS, risk_level, severity_rank
from .operators import action_gate, audit, classifier, custom
from .operators.action_gate import ActionRule
from .operators.custom import CodeDetector
from .operators.scan import PUBLIC, scan, threats
from .operators.sessions import SessionScan, accumulated, scan_sessions, trailing_window
from .sources.patterns import REGISTRY, DetectorSpec, PatternDatabase, default_database

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Config:
    strictness: str = "balanced"
    normalize: bool = True
    sanitize_mode: str = "merged"
    disabled: frozenset[str] = frozenset()
    custom: tuple[DetectorSpec, ...] = ()
    code: tuple[CodeDetector, ...] = ()
    scorer: Callable | None = None
    ml_threshold: float = 0.5
    window_turns: int = 8
    window_chars: int = 4000
    accumulate: bool = False
    rules: tuple[ActionRule, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.strictness not in THRESHOLDS:
            raise ValueError(f"unknown strictness {self.strictness}")
        if self.sanitize_mode not in ("merged", "sequential"):
            raise ValueError(f"unknown sanitize_mode {self.sanitize_mode}")


class ThreatEngine:
    """Scans texts, chunks, outputs and conversations, checks actions, and keeps audit records."""

    def __init__(self, spark: SparkSession, config: Config | None = None, database: PatternDatabase | None = None):
        self.spark, self.config = spark, config or Config()
        self._source = database or default_database()
        known = {d.id for d in self._source.detectors}
        self.skipped = sorted(self.config.disabled & known)
        self.database = self._source.only(known - self.config.disabled)
        for spec in self.config.custom:
            self.database = self.database.with_detector(spec)
        if self.config.accumulate and self.config.scorer is None:
            log.warning("accumulation needs a scorer; it is off")

    @property
    def pattern_version(self) -> str:
        return self.database.version

    @property
    def strictness(self) -> str:
        return self.config.strictness

    def with_patterns(self, database: PatternDatabase) -> ThreatEngine:
        """An engine with the whole pattern database replaced."""
        return ThreatEngine(self.spark, self.config, database)

    def with_config(self, **changes) -> ThreatEngine:
        return ThreatEngine(self.spark, replace(self.config, **changes), self._source)

    def _options(self) -> dict:
        c = self.config
        return {"strictness": c.strictness, "normalize": c.normalize, "sanitize_mode": c.sanitize_mode}

    def events(self) -> DataFrame:
        """One row for each detector of the registry that does not run: event, detector_id and reason."""
        have = {d.id for d in self._source.detectors}
        rows = [("detector_skipped", r[0], "config-disabled" if r[0] in self.config.disabled else "no-patterns") for r in REGISTRY if r[0] in self.config.disabled or r[0] not in have]
        return self.spark.createDataFrame(rows, "event string, detector_id string, reason string")

    def scan(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """df with threats, clean, sanitized, risk_level, threats_found, detectors_run, highest_severity. With a scorer
        its labels, with detectors given as code their finds are threats too, and detector_errors (detector_id and
        message) says which of them raised on the row; the others' threats stand."""
        out, c = scan(df, self.database, text_col, **self._options()), self.config
        if c.scorer is None and not c.code:
            return out
        more, errors, text = [], [], F.coalesce(F.col(text_col), F.lit(""))
        if c.code:
            out = custom.with_code_threats(out, text_col, c.code, THRESHOLDS[c.strictness])
            more.append(F.col("code_threats"))
            errors.append(F.col("code_errors"))
        if c.scorer is not None:
            out = classifier.with_logits(out, text_col, c.scorer)
            more.append(classifier.label_threats(text, F.col("logits"), c.ml_threshold))
            error = F.struct(F.lit("ml-classifier").alias("detector_id"), F.col("scorer_error").alias("message"))
            errors.append(F.filter(F.array(error), lambda e: e["message"].isNotNull()))
        added = F.filter(F.concat(*more), lambda t: t["confidence"] >= THRESHOLDS[c.strictness])
        ranked = F.transform(F.concat("threats", added), lambda t, i: F.struct((-severity_rank(t["severity"])).alias("s"), (-t["confidence"]).alias("c"), i.alias("i"), t.alias("t")))
        out = out.withColumns({"threats": F.transform(F.array_sort(ranked), lambda r: r["t"]), "detector_errors": F.concat(*errors)})
        top = F.get("threats", F.lit(0))
        ran = F.col("detectors_run") + (len(c.code) + int(c.scorer is not None))
        out = out.withColumns({"clean": F.size("threats") == 0, "threats_found": F.size("threats"), "detectors_run": ran, "risk_level": risk_level(top["severity"], top["confidence"]), "highest_severity": top["severity"]})
        return out.drop("code_threats", "code_errors", "logits", "scorer_error")

    def threats(self, df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
        return threats(self.scan(df, text_col), *keys)

    def scan_chunks(self, df: DataFrame, batch_col: str, index_col: str, text_col: str = "text") -> DataFrame:
        """Retrieved chunks: each scanned alone, with its batch and index."""
        return self.scan(df, text_col).withColumns({"audit_source": F.lit("rag-chunk"), "audit_batch": F.col(batch_col).cast("string"), "audit_index": F.col(index_col).cast("int")})

    def scan_output(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return self.scan(df, text_col).withColumn("audit_source", F.lit("output"))

    def scan_session(self, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> SessionScan:
        c = self.config
        return scan_sessions(turns, self.database, conv_col, turn_col, text_col, c.window_turns, c.window_chars, **self._options())

    def accumulated(self, turns: DataFrame, session: SessionScan, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
        """Labels that only the trailing turns together have; needs a scorer and accumulate."""
        if self.config.scorer is None or not self.config.accumulate:
            raise ValueError("accumulation needs a scorer and accumulate=True")
        windows = trailing_window(turns, conv_col, turn_col, text_col, self.config.window_turns, self.config.window_chars)
        scored = classifier.with_logits(windows, "joined", self.config.scorer)
        labels = scored.select(conv_col, F.explode(classifier.label_threats(F.col("joined"), F.col("logits"), self.config.ml_threshold)).alias("t")).select(conv_col, "t.type", "t.severity", "t.confidence")
        types = session.turns.select(F.col("conv").alias(conv_col), F.explode("threats").alias("t")).select(conv_col, "t.type")
        return accumulated(windows, types, labels, conv_col)

    def check_actions(self, requests: DataFrame, tool_col: str = "tool", args_col: str = "args") -> DataFrame:
        return action_gate.check_actions(requests, list(self.config.rules), tool_col, args_col)

    def audit(self, scanned: DataFrame, source: str, key: Column, **options) -> DataFrame:
        return audit.audit_records(scanned, source, self.strictness, self.pattern_version, key, **options)


assert PUBLIC[0] == "category"
