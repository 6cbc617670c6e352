"""The scan kernel as DuckDB SQL, for checking. RE2 has no look-ahead, so only patterns without it take part."""

from __future__ import annotations

import re
from dataclasses import replace

from ..functions.risk import THRESHOLDS
from ..sources.patterns import PatternDatabase, default_database
from .planted import sql_literal


def portable_database() -> PatternDatabase:
    """The default patterns that RE2 can run."""
    db = default_database()
    kept = [replace(d, patterns=tuple(p for p in d.patterns if "(?!" not in p.regex and "u" not in p.flags)) for d in db.detectors]
    return replace(db, detectors=tuple(d for d in kept if d.patterns))


def to_re2(regex: str, flags: str) -> str:
    regex = regex.replace("[^]", r"[\s\S]")
    regex = re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", regex)
    return f"(?{''.join(f for f in 'im' if f in flags)})" + regex if set(flags) & set("im") else regex


def threats_sql(source: str, keys: str, text: str, strictness: str = "balanced") -> str:
    """SELECT keys, det, pat, i, and the threat's fields for every threat in the rows of `source`."""
    rows, n = [], 0
    db = portable_database()
    for d_no, d in enumerate(db.detectors):
        for p in d.patterns:
            raised = dict(d.raise_to).get(p.severity, p.severity)
            rows.append(
                f"({d_no}, {n}, {sql_literal(d.id)}, {sql_literal(p.id)}, {sql_literal(to_re2(p.regex, p.flags))}, {sql_literal(p.category)}, {sql_literal(p.type)}, {sql_literal(p.severity)}, {sql_literal(raised)}, "
                f"{p.confidence}::DOUBLE, {min(1.0, p.confidence + d.boost)!r}::DOUBLE, {sql_literal(p.label)}, {p.extract_group}, {p.min_length}, {p.boost}, {p.require}, {d.masked})"
            )
            n += 1
    signals = sql_literal(to_re2(db.detectors[0].signals, "i"))
    columns = "det, pat, detector_id, pattern_id, regex, category, type, severity, raised, confidence, boosted, label, grp, least, boost, require, masked"
    return f"""
  SELECT {keys}, det, pat, i, detector_id, pattern_id, category, type,
         CASE WHEN boost AND signal THEN raised ELSE severity END AS severity,
         round(CASE WHEN boost AND signal THEN boosted ELSE confidence END, 4) AS confidence,
         label || CASE WHEN signal THEN ' with instruction-like language' ELSE '' END AS description,
         CASE WHEN masked THEN CASE WHEN length(trim(w)) <= 4 THEN '[REDACTED]' ELSE left(trim(w), 4) || '[REDACTED ' || length(trim(w)) || ' chars]' END
              WHEN length(w) > 200 THEN left(w, 197) || '...' ELSE w END AS evidence,
         spot AS location_offset, length(w) AS location_length
  FROM (
    SELECT *, regexp_matches(e, {signals}) AS signal FROM (
      SELECT *, whole[i] AS w, trim(CASE WHEN grp = 0 THEN whole[i] ELSE parts[i] END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e,
             (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0))::INT AS spot
      FROM (
        SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
          SELECT s.*, p.*, regexp_extract_all({text}, regex) AS whole, string_split_regex({text}, regex) AS gaps,
                 CASE WHEN grp = 1 THEN regexp_extract_all({text}, regex, 1) END AS parts
          FROM {source} s, (VALUES {", ".join(rows)}) p({columns})
          WHERE regexp_matches({text}, regex)
        )
      )
    )
  )
  WHERE length(e) >= least AND NOT (require AND NOT signal) AND NOT (boost AND NOT signal AND confidence < 0.5)
    AND CASE WHEN boost AND signal THEN boosted ELSE confidence END >= {THRESHOLDS[strictness]}"""


def rank_sql(column: str) -> str:
    return f"CASE {column} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"


def position_sql(partition: str) -> str:
    return f"row_number() OVER (PARTITION BY {partition} ORDER BY {rank_sql('severity')} DESC, confidence DESC, det, pat, i) - 1"


LEVEL_SQL = """CASE WHEN severity IS NULL THEN 'none'
  WHEN severity = 'critical' THEN CASE WHEN confidence >= 0.8 THEN 'critical' WHEN confidence >= 0.5 THEN 'high' ELSE 'medium' END
  WHEN severity = 'high' THEN CASE WHEN confidence >= 0.5 THEN 'high' ELSE 'medium' END
  WHEN severity = 'medium' THEN CASE WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END
  ELSE 'low' END"""
