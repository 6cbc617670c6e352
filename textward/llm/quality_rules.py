"""Quality rules with cross-document line frequency. DataFrame operations only.

One pass over the texts computes the base figures and each document's distinct normalised lines; the rest works on
those. A line is boilerplate on a host when more of its documents hold it than the limits allow. Documents with
the same set of normalised lines count once: copies of one text would otherwise make its own lines look like
boilerplate, and removing copies is another operator's work. A document that is mostly boilerplate is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WHITE, let, materialise, row_numbers

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Words of a non-null text."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array w. Windows are sorted by hash with their
    positions; neighbours of equal hash are repeats, so the cost is n log n also for very long texts."""
    n = F.size(w)

    def covered(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            last = F.size(s) - 1
            repeated = F.filter(
                s,
                lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])),
            )
            return let(
                F.array_sort(F.transform(repeated, lambda x: x["at"])),
                lambda p: F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n")))["n"],
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
            let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), of_sorted)
        )

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 3, 0).otherwise(let(hashes, covered)).cast("long")


def normalised_line(line: Column) -> Column:
    """Lower case, digits as 0, runs of other white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE + "+", " "))


def line_key(line: Column) -> Column:
    """60 bits of the line's MD5 as a positive long, the same in any engine."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def base_figures(docs: DataFrame, doc_col: str, text_col: str, host_col: str, with_text: bool = False, row_col: str | None = None) -> DataFrame:
    """Per row of docs: row_id, doc_id, host, the base figures, lines (key, chars), one for each line with a word, and,
    with_text, the row itself as original."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(row_numbers(row_col).alias("row_id"), F.col(doc_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"), *([F.struct("*").alias("original")] if with_text else []))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    keyed = F.transform(lines, lambda x: let(normalised_line(x), lambda y: F.struct(line_key(y).alias("key"), F.length(y).cast("long").alias("chars"))))
    return rows.select(
        "row_id",
        "doc_id",
        "host",
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        keyed.alias("lines"),
        *(["original"] if with_text else []),
    ).select("row_id", "doc_id", "host", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "lines", *(["original"] if with_text else []))


def quality_rules(
    docs: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    least_documents: int = 20,
    host_share: float = 0.02,
    depleted_share: float = 0.8,
    least_words: int = 50,
    repeat_percent: int = 50,
    with_text: bool = False,
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of docs: row_id (row_col, if given), doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, line_chars (of normalised lines), boilerplate_chars (of those in lines above the limits),
    removed_lines (lines above the limits).

    A line is above the limits on a host if more than least_documents and more than host_share of the host's documents
    hold it (on both sides documents with the same set of normalised lines count once). A document is rejected if it fails the base rules
    (fewer than least_words words, or over repeat_percent of them in repeated 3-word windows) or if more than
    depleted_share of its line characters are boilerplate. with_text adds clean_text, the text without its lines above
    the limits (null for a null text), and original, the whole row.

    Null text: no words, base_failed. Null host: a host of its own, shared with ''. Repeated rows are judged each and
    count as one document. Extra columns are ignored. An empty table gives no rows."""
    keys = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["key"])))
    figures = materialise(base_figures(docs, doc_col, text_col, host_col, with_text, row_col).withColumn("line_set", line_key(F.array_join(keys.cast("array<string>"), ","))), "line-figures")
    on_host = figures.where(F.size("lines") > 0).select("host", "line_set", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
    host_docs = figures.groupBy("host", "line_set").agg(F.lit(1)).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counted = on_host.groupBy("host", "key", "line_set").agg(F.lit(1)).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > least_documents)
    common = materialise(counted.join(host_docs, "host").where(F.col("n_docs") > host_share * F.col("host_docs")).select("host", "key"), "common-lines")
    lines = figures.select("row_id", "host", F.explode("lines").alias("line")).select("row_id", "host", "line.key", "line.chars")
    hit = lines.join(common, ["host", "key"], "left_semi").groupBy("row_id").agg(F.sum("chars").alias("hit"), F.count(F.lit(1)).alias("hit_lines"), *([F.collect_set("key").alias("hit_keys")] if with_text else []))
    base_failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    judged = figures.withColumn("line_chars", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])).drop("lines").join(hit, "row_id", "left")
    text = F.col("original")[text_col] if with_text else None
    # blank lines have the key of an empty line, which is never counted
    clean = F.when(F.col("hit_keys").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("hit_keys", line_key(normalised_line(x)))), "\n")) if with_text else None
    return judged.select(
        "row_id",
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (F.coalesce("hit", F.lit(0)) <= depleted_share * F.col("line_chars"))).alias("kept"),
        "line_chars",
        F.coalesce("hit", F.lit(0).cast("long")).alias("boilerplate_chars"),
        F.coalesce("hit_lines", F.lit(0).cast("long")).alias("removed_lines"),
        *([clean.alias("clean_text"), "original"] if with_text else []),
    )


def quality_rules_query(docs: DataFrame) -> DataFrame:
    """Contract of op3."""
    return quality_rules(docs).drop("row_id")


QUALITY_RULES_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw_lines
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id
), b AS (
  SELECT d.doc_id, host, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(raw_lines) - len(list_distinct(raw_lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         list_transform(raw_lines, lambda x: trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS lines
  FROM d LEFT JOIN cov USING (doc_id)
), l AS (
  SELECT doc_id, host, md5(line)[:15] AS key, length(line) AS chars
  FROM (SELECT doc_id, host, unnest(lines) AS line FROM b)
), f AS (
  SELECT doc_id, list_sort(list(DISTINCT key)) AS line_set FROM l GROUP BY doc_id
), h AS (SELECT host, coalesce(line_set, []) AS line_set, doc_id FROM b LEFT JOIN f USING (doc_id)),
common AS (
  SELECT host, key FROM (
    SELECT l.host, key, count(DISTINCT line_set) AS n FROM l JOIN f USING (doc_id) GROUP BY l.host, key
  ) JOIN (SELECT host, count(DISTINCT line_set) AS host_docs FROM h GROUP BY host) USING (host)
  WHERE n > 20 AND n > 0.02 * host_docs
), c AS (
  SELECT doc_id, sum(chars)::BIGINT AS line_chars,
         (count(*) FILTER ((host, key) IN (SELECT (host, key) FROM common)))::BIGINT AS removed_lines,
         coalesce(sum(chars) FILTER ((host, key) IN (SELECT (host, key) FROM common)), 0)::BIGINT AS boilerplate_chars
  FROM l GROUP BY doc_id
), r AS (
  SELECT b.*, coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(boilerplate_chars, 0)::BIGINT AS boilerplate_chars,
         coalesce(removed_lines, 0)::BIGINT AS removed_lines,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM b LEFT JOIN c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND boilerplate_chars <= 0.8 * line_chars AS kept, line_chars, boilerplate_chars, removed_lines
FROM r
"""
