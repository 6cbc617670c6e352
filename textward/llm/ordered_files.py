"""Documents tokenised and handed, a file's worth at a time, to a writer on the executors; in doc_id order if asked."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise
from .tokens import END_ID, id_batches

#: Text bytes an id stands for at least, roughly; only sizes files.
BYTES_PER_ID = 2.5
#: Digits of a partition's number within which files are summed together.
GROUP_DIGITS = 4
MANIFEST = "file string, n_docs long, n_ids long"


def put_file(uri: str, parts: list[bytes]) -> None:
    """Write parts as one file; a repeated or late attempt of a task replaces it whole or not at all."""
    fs, path = pafs.FileSystem.from_uri(uri)
    held = f"{path}.attempt-{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(held) as out:
        for part in parts:
            out.write(part)
    fs.move(held, path)


def put_folder_file(uri: str, content: bytes) -> None:
    """Write one file from the driver into a shared folder."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_output_stream(path) as out:
        out.write(content)


def make_folder(uri: str) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)


def in_order(docs: DataFrame, ids_per_file: int) -> DataFrame:
    """docs(doc_id, text) dealt by doc_id range (null first) to partitions of about ids_per_file ids, sorted in each."""
    text_bytes = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 3)).first()[0] or 0
    parts = max(1, math.ceil(text_bytes / (BYTES_PER_ID * ids_per_file)))
    return docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")


def write_files(docs: DataFrame, vocabulary: str, folder: str, ids_per_file: int, encode: Callable[[list, list[np.ndarray]], dict[str, list[bytes]]], end_id: int = END_ID, escaped: bool = False) -> DataFrame:
    """Write docs(doc_id, text), partition after partition in their order, as files of at most twice ids_per_file ids
    (more only for one document) whose names sort in that order. encode(doc ids, id arrays) gives the bytes of a file,
    or of several by suffix. Returns the table file (name without suffix), n_docs, n_ids of them."""
    make_folder(folder)

    def write(batches):
        part, made = TaskContext.get().partitionId(), 0
        docs_held: list = []
        ids_held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal made, size
            name = f"part-{part:07d}-{made:05d}"
            for suffix, content in encode(docs_held, ids_held).items():
                put_file(f"{folder}/{name}{suffix}", content)
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(docs_held)], pa.int64()), pa.array([size], pa.int64())], names=["file", "n_docs", "n_ids"])
            made, size = made + 1, 0
            docs_held.clear()
            ids_held.clear()
            return row

        for rows in id_batches(batches, vocabulary, end_id, escaped=escaped):
            for doc, ids in rows:
                if docs_held and size + len(ids) > 2 * ids_per_file:
                    yield flush()
                docs_held.append(doc)
                ids_held.append(ids)
                size += len(ids)
        if docs_held:
            yield flush()

    return materialise(docs.mapInArrow(write, MANIFEST), "manifest")


def bases(files: DataFrame, order: str, size: Column) -> DataFrame:
    """files with base: the sizes of all files before each, by the column `order`. A prefix sum in two levels: names
    that agree up to their last GROUP_DIGITS digits of the partition number are summed first."""
    rows = files.withColumn("size_", size).withColumn("group_", F.regexp_extract(order, r"^(.*part-\d+)\d{%d}-\d+" % GROUP_DIGITS, 1))
    before = lambda *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("group_").agg(F.sum("size_").alias("size_"))
    in_order = Window.orderBy("group_").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("group_", F.coalesce(F.sum("size_").over(in_order), F.lit(0)).alias("group_base"))
    within = rows.withColumn("within", F.coalesce(F.sum("size_").over(before("group_")), F.lit(0)))
    return within.join(groups, "group_").withColumn("base", F.col("group_base") + F.col("within")).drop("group_", "size_", "group_base", "within")
