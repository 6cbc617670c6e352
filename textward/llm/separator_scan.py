"""Token counts by separator scan: flat files of ids with no index, cut at end-of-document ids.

Files are read in fixed-size blocks, each by itself: numpy finds the separators of a block at once. A document may
begin in one block and end in another, so a prefix scan over the blocks of a file (running maximum of the last
separator's position, running count of separators) gives each block what it needs from those before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered_files import bases, write_files
from .shared import scratch
from .tokens import vocabulary_path

SUFFIX, NAMES = ".ids", ".docs"
NULL_NAME = -(1 << 63)
BLOCKS = "file string, block long, n_seps long, last_sep long, seps array<long>"


def scan_flat_files(spark: SparkSession, folder: str, separator: int, id_bytes: int = 2, block_ids: int = 1 << 18, suffix: str = SUFFIX) -> DataFrame:
    """One row per document of the flat little-endian id files `folder`/*suffix: file, ordinal (in its file, from 0),
    start (ids before it in its file, separators counted), n_tokens (without its separator), ended (false only for ids
    after a file's last separator). Documents without ids count 0; empty files and folders give no rows."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    blocks = (
        listed.where("length > 0")
        .select("path", F.floor(F.col("length") / id_bytes).alias("n_ids"))
        .select("path", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ids") - 1) / block_ids))).alias("block"))
        .repartition(F.col("path"), F.col("block"))
    )
    kind = f"<u{id_bytes}"

    def scan(batches):
        for batch in batches:
            for path, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fs, local = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(local) as f:
                    f.seek(block * block_ids * id_bytes)
                    ids = np.frombuffer(f.read(block_ids * id_bytes), dtype=kind)
                seps = np.flatnonzero(ids == separator) + block * block_ids
                last = int(seps[-1]) if len(seps) else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rsplit("/", 1)[-1]]), pa.array([block], pa.int64()), pa.array([len(seps)], pa.int64()), pa.array([last], pa.int64()), pa.array([seps.tolist()], pa.list_(pa.int64()))],
                    names=["file", "block", "n_seps", "last_sep", "seps"],
                )

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocks.mapInArrow(scan, BLOCKS)
    stitched = scanned.select(
        "file",
        F.coalesce(F.sum("n_seps").over(before), F.lit(0)).alias("first"),
        F.concat(F.array(F.coalesce(F.max("last_sep").over(before), F.lit(-1).cast("long"))), "seps").alias("edges"),
    )
    k = F.col("k").cast("long")
    whole = stitched.select("file", "first", "edges", F.explode(F.sequence(F.lit(1), F.size("edges"))).alias("k")).where(F.col("k") < F.size("edges")).select(
        "file",
        (F.col("first") + k - 1).alias("ordinal"),
        (F.element_at("edges", F.col("k")) + 1).alias("start"),
        (F.element_at("edges", F.col("k") + 1) - F.element_at("edges", F.col("k")) - 1).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    rest = (
        listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.floor(F.col("length") / id_bytes).alias("n_ids"))
        .join(scanned.groupBy("file").agg(F.sum("n_seps").alias("ordinal"), F.max("last_sep").alias("last")), "file")
        .select("file", "ordinal", (F.coalesce("last", F.lit(-1)) + 1).alias("start"), (F.col("n_ids") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("ended"))
        .where("n_tokens > 0")
    )
    return whole.unionByName(rest)


def write_flat_files(docs: DataFrame, vocabulary: str, folder: str, separator: int, ids_per_file: int = 4_000_000, id_bytes: int = 2) -> None:
    """Write docs(doc_id, text), in the order of its partitions and without a shuffle, as flat files of ids, each
    document closed by the separator, an id no text has. The files hold neither index nor doc ids; beside each, NAMES
    lists its doc ids in order. An empty table writes nothing."""
    kind = f"<u{id_bytes}"

    def flat(doc_ids, ids):
        if max(int(x.max()) for x in ids) >> 8 * id_bytes:
            raise ValueError("ids do not fit id_bytes")
        names = np.array([NULL_NAME if d is None else d for d in doc_ids], dtype="<i8")
        return {SUFFIX: [np.concatenate(ids).astype(kind).tobytes()], NAMES: [names.tobytes()]}

    write_files(docs, vocabulary, folder, ids_per_file, flat, separator, escaped=True)


def read_names(spark: SparkSession, folder: str) -> DataFrame:
    """file (of the ids), ordinal and doc_id from the NAMES files."""
    def names(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(content.as_py(), "<i8")
                file = path.rsplit("/", 1)[-1].removesuffix(NAMES) + SUFFIX
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(ids), pa.string()), pa.array(np.arange(len(ids))), pa.array(ids, mask=ids == NULL_NAME)], names=["file", "ordinal", "doc_id"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{NAMES}").load(folder)
    return found.select("path", "content").mapInArrow(names, "file string, ordinal long, doc_id long")


def token_counts(docs: DataFrame, vocabulary: str, separator: int, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (without the separator) and start (ids before it in the files in order, separators counted) of
    each row of docs, by writing flat files and scanning them. Null and empty texts count 0; a null doc_id stays null;
    repeated rows give a row each; extra columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    folder = scratch(spark, "flat-ids")
    write_flat_files(docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), vocabulary, folder, separator)
    scanned = scan_flat_files(spark, folder, separator)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    placed = bases(files, "file", F.floor(F.col("length") / 2)).select("file", "base")
    return scanned.join(read_names(spark, folder).hint("merge"), ["file", "ordinal"]).join(placed, "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens")


def token_counts_query(docs: DataFrame) -> DataFrame:
    """op9: tokens of every document under the byte BPE vocabulary, whose end-of-text id closes documents."""
    return token_counts(docs, vocabulary_path("byte_bpe_50k.json"), 50256)
