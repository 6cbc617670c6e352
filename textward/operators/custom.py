"""Detectors given as code: their threats beside those of the patterns, their errors kept apart from the job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THREAT = "struct<category:string,type:string,severity:string,confidence:double,description:string,evidence:string,location:struct<offset:int,length:int>,detector_id:string,pattern_id:string,source:string>"
ERROR = "struct<detector_id:string,message:string>"


@dataclass(frozen=True)
class CodeDetector:
    """find(text) gives threats as dicts: type, severity and confidence, if it likes description, evidence, offset and
    length, pattern_id. replacement, if given, stands for the evidence of its threats in the sanitised text."""

    id: str
    category: str
    find: Callable[[str], list[dict]]
    replacement: str | None = None


def _shaped(detector: CodeDetector, text: str, threat: dict) -> dict:
    at, n = threat.get("offset"), threat.get("length")
    where = None if at is None or n is None else {"offset": int(at), "length": int(n)}
    evidence = threat.get("evidence") or ("" if where is None else text[at : at + n])
    return {
        "category": threat.get("category", detector.category), "type": str(threat["type"]), "severity": str(threat["severity"]), "confidence": float(threat["confidence"]),
        "description": threat.get("description", ""), "evidence": evidence if len(evidence) <= 200 else evidence[:197] + "...", "location": where,
        "detector_id": detector.id, "pattern_id": threat.get("pattern_id"), "source": threat.get("source", "custom"), "whole": evidence,
    }


def found_by(detectors: tuple[CodeDetector, ...], text: str) -> tuple[list[dict], list[dict]]:
    """Threats of all detectors in their order, and an error for each detector that raised; its threats are left out."""
    threats, errors = [], []
    for d in detectors:
        try:
            threats += [_shaped(d, text, t) for t in d.find(text)]
        except Exception as error:  # a user's code may raise anything, and must not stop the scan
            errors.append({"detector_id": d.id, "message": f"{type(error).__name__}: {error}"})
    return threats, errors


def with_code_threats(df: DataFrame, text_col: str, detectors: tuple[CodeDetector, ...], least: float) -> DataFrame:
    """A scan with code_threats (confidence of `least` or more) and code_errors of the detectors, and sanitized with
    their replacements after those of the patterns. Null text counts as empty. Texts go to Arrow workers once."""
    put = {d.id: d.replacement for d in detectors if d.replacement is not None}

    @F.pandas_udf(f"struct<threats:array<{THREAT}>,errors:array<{ERROR}>,cuts:array<struct<whole:string,put:string>>>")
    def find(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            threats, errors = found_by(detectors, text or "")
            threats = [t for t in threats if t["confidence"] >= least]
            cuts = [{"whole": t.pop("whole"), "put": put.get(t["detector_id"])} for t in threats]
            out.append((threats, errors, [c for c in cuts if c["whole"] and c["put"] is not None]))
        return pd.DataFrame(out, columns=["threats", "errors", "cuts"])

    found = df.withColumn("_code", find(F.col(text_col)))
    left = F.aggregate(F.col("_code.cuts"), F.col("sanitized"), lambda acc, c: F.replace(acc, c["whole"], c["put"]))
    return found.withColumns({"code_threats": F.col("_code.threats"), "code_errors": F.col("_code.errors"), "sanitized": left}).drop("_code")
