"""License scan by diagonal voting. DataFrame operations only.

Every rolling word pair of every text is joined with the pairs of the templates (broadcast: their number is fixed).
A hit votes for the diagonal document position - template position; neighbouring diagonals are merged, which bridges a
word put in or left out, and a template found over enough of its length labels the document. Hits carry their words,
and those must equal the template's, so hashes never decide alone. No text is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and labels: fixed values of the contract.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: The method's own templates: sentences of well-known licence notices.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]
#: Pairs made only of these words cast no vote.
COMMON_WORDS = {"a", "all", "and", "any", "as", "by", "for", "in", "is", "it", "may", "of", "or", "the", "this", "to", "under", "use", "with", "without", "you"}


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def template_pairs(spark: SparkSession) -> DataFrame:
    """template, label, is_base, n_pairs (that vote), at, first, second, h (of both words): one row per voting pair."""
    rows = []
    for k, (text, label) in enumerate(BASE + NOTICES):
        base, w = k < len(BASE), text.split(" ")
        pairs = [(i, a, b) for i, (a, b) in enumerate(zip(w, w[1:], strict=False)) if base or not {a, b} <= COMMON_WORDS]
        rows += [(k, label, base, len(pairs), i, a, b) for i, a, b in pairs]
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, n_pairs int, at int, first string, second string").withColumn("h", F.xxhash64("first", "second"))


def license_scan(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", least_score: float = 0.8, drift: int = 3) -> DataFrame:
    """One row per row of docs: row_id, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A base phrase must stand whole on one diagonal; n_base counts its places. A notice labels the document when, on
    diagonals at most `drift` apart, at least least_score of its pairs are found. score is the best share found of any
    notice or base phrase (base phrases count only whole), 0 without one. Null or empty text: no words, empty labels.
    Repeated rows are scanned each. Extra columns are ignored. An empty table gives no rows."""
    pairs = F.broadcast(template_pairs(docs.sparkSession))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_col).cast("long").alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    # a row for each word with its successor; the one at position -1 stands for the document
    grams = let(
        F.filter(F.split("text", GAP), lambda w: w != ""),
        lambda w: F.concat(
            F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("a"), F.lit("").alias("b"), F.size(w).alias("n"))),
            F.transform(w, lambda x, i: F.struct(i.alias("pos"), x.alias("a"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("b"), F.lit(0).alias("n"))),
        ),
    )
    exploded = rows.select("row_id", "doc_id", F.explode(grams).alias("g")).select("row_id", "doc_id", "g.pos", "g.a", "g.b", "g.n")
    same = (F.xxhash64("a", "b") == F.col("h")) & (F.col("a") == F.col("first")) & (F.col("b") == F.col("second"))
    hits = exploded.join(pairs, same, "left").where((F.col("pos") < 0) | F.col("template").isNotNull())
    votes = (
        hits.groupBy("row_id", "doc_id", "template", "label", "is_base", "n_pairs", (F.col("pos") - F.coalesce("at", F.lit(0))).alias("diagonal"))
        .agg(F.collect_set("at").alias("ats"), F.max("n").alias("n"))
    )
    by_document = Window.partitionBy("row_id", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by_document) > F.when(F.col("is_base"), 0).otherwise(drift)).cast("int"), F.lit(0))
    merged = (
        votes.withColumn("apart", apart)
        .withColumn("run", F.sum("apart").over(by_document))
        .groupBy("row_id", "doc_id", "template", "label", "is_base", "n_pairs", "run")
        .agg(F.min("diagonal").alias("diagonal"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("found"), F.max("n").alias("n"))
        .withColumn("share", F.col("found") / F.col("n_pairs"))
    )
    base = F.col("is_base") & (F.col("share") == 1)
    own = ~F.col("is_base") & (F.col("share") >= least_score)
    names = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    return merged.groupBy("row_id", "doc_id").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(base | own).alias("labels"),
        F.coalesce(F.max(F.when(base | ~F.col("is_base"), F.col("share"))), F.lit(0.0)).alias("score"),
    )


def license_scan_query(docs: DataFrame) -> DataFrame:
    """Contract of op6."""
    return license_scan(docs).drop("row_id")


def _sql() -> str:
    values = ",\n    ".join(f"({k}, '{t}', '{label}', {'true' if k < len(BASE) else 'false'})" for k, (t, label) in enumerate(BASE + NOTICES))
    common = ", ".join(f"'{w}'" for w in sorted(COMMON_WORDS))
    return rf"""
WITH t(template, phrase, label, is_base) AS (VALUES
    {values}
), tw AS (SELECT template, label, is_base, string_split(phrase, ' ') AS p FROM t),
tp AS (
  SELECT template, label, is_base, i - 1 AS tpos, p[i] AS a, p[i + 1] AS b
  FROM (SELECT *, unnest(range(1, len(p))) AS i FROM tw)
  WHERE is_base OR p[i] NOT IN ({common}) OR p[i + 1] NOT IN ({common})
), tn AS (SELECT template, count(*) AS n_pairs FROM tp GROUP BY template),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)
), v AS (
  SELECT doc_id, template, label, is_base, pos - tpos AS diagonal, tpos FROM g JOIN tp USING (a, b)
), dg AS (SELECT DISTINCT doc_id, template, is_base, diagonal FROM v),
ap AS (
  SELECT *, coalesce((diagonal - lag(diagonal) OVER w > CASE WHEN is_base THEN 0 ELSE 3 END)::INT, 0) AS apart
  FROM dg WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)
), rn AS (
  SELECT doc_id, template, diagonal, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM ap
), m AS (
  SELECT doc_id, template, label, is_base, run, min(diagonal) AS diagonal, count(DISTINCT tpos) / any_value(n_pairs) AS share
  FROM v JOIN rn USING (doc_id, template, diagonal) JOIN tn USING (template)
  GROUP BY doc_id, template, label, is_base, run
), q AS (
  SELECT doc_id,
         count(*) FILTER (is_base AND share = 1) AS n_base,
         min(diagonal) FILTER (is_base AND share = 1) AS first_word,
         max(diagonal) FILTER (is_base AND share = 1) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base AND share = 1) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= CASE WHEN is_base THEN 1 ELSE 0.8 END) AS labels,
         max(share) FILTER (NOT is_base OR share = 1) AS score
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN q USING (doc_id)
"""


LICENSE_SCAN_SQL = _sql()
assert all(re.fullmatch("[a-z0-9 ]+", t) for t, _ in BASE + NOTICES)
