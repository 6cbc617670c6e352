"""Exact dedup against a persistent digest index, bucketed and sorted by digest. DataFrame operations only.

A batch is reduced to one row per digest (partial aggregation first, so a hot text costs one row a task), matched with
the index by a sort-merge anti-join that reads the index without a shuffle, and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WHITE, materialise, row_numbers, scratch

INDEX = "digest string, keep_row long, keep_id long, group_size long"


def without_white(text):
    """Text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def digests(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row_id, doc_id, digest (SHA-256 of the text without white space) and n_chars, kept in the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        row_numbers(row_col).alias("row_id"),
        F.col(doc_col).cast("long").alias("doc_id"),
        F.sha2(without_white(F.col(text_col)), 256).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
    )
    return materialise(rows, "digests")


class DigestIndex:
    """One row per digest seen so far, as a table bucketed and sorted by digest at a path all executors reach.

    The same path opens it again in a later session. ingest() is safe to repeat: rows whose digest is there already
    are not appended a second time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, table: str | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({INDEX}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Forget the table's name; its files stay. Frames made before go on reading them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Append the digests of batch (from digests()) that the index has not seen, and return the index. Of a new
        digest the row with the most characters stays, then the smallest doc_id (null last), then the first row."""
        first = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row_id")
        groups = batch.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new = new.select("digest", F.col("first.row_id").alias("keep_row"), F.col("first.doc_id").alias("keep_id"), "group_size")
        new.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)
        return self.rows()


def with_groups(batch: DataFrame, index: DataFrame, hot: int) -> DataFrame:
    """batch with its index rows. Digests with at least `hot` rows (so at most rows / hot of them) are broadcast and
    their rows stay where they are; the others meet the index by sort-merge join."""
    index = index.withColumnRenamed("digest", "index_digest")
    many = F.broadcast(index.where(F.col("group_size") >= hot))
    marked = batch.join(many, F.col("digest") == F.col("index_digest"), "left")
    known = marked.where(F.col("index_digest").isNotNull())
    rest = marked.where(F.col("index_digest").isNull()).select(*batch.columns)
    few = index.where(F.col("group_size") < hot).hint("merge")
    return known.unionByName(rest.join(few, F.col("digest") == F.col("index_digest"))).drop("index_digest")


def exact_dedup(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: row_id (row_col, if given), doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null and empty texts form one group. Repeated rows count
    in group_size and one of them is kept. A null doc_id is kept only if no other row ties with it. Extra columns are
    ignored. An empty table gives no rows. At most 10,000 digests are broadcast, whatever the input."""
    spark = docs.sparkSession
    batch = digests(docs, doc_col, text_col, row_col)
    index = DigestIndex(spark, scratch(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    index.ingest(batch)
    hot = max(64, batch.count() // 10_000)
    return with_groups(batch, index.rows(), hot).select("row_id", "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup_query(docs: DataFrame) -> DataFrame:
    """Contract of op2."""
    return exact_dedup(docs).drop("row_id")


EXACT_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""
