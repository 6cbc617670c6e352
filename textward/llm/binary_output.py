"""Token ids as files of byte-aligned, variable-length, frequency-ranked codes.

A file ranks its ids by their frequency in it, so the commonest 256 take one byte, and is read without any other file.
It holds, in this order: magic, counts of documents, ids and distinct ids, the distinct ids by rank, doc ids with null
marks, ids per document, control bytes (four 2-bit lengths each) and, apart from them, data bytes. numpy decodes by
looking each control byte up in a table of four lengths.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered_files import bases, in_order, write_files
from .shared import materialise, scratch
from .tokens import vocabulary_path

MAGIC, SUFFIX = b"TWV2", ".twv"
HEAD = "<QQQ"
#: Control byte -> the byte lengths of its four codes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_codes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of codes under 2**32."""
    codes = codes.astype(np.uint32)
    extra = (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    at = np.cumsum(extra.astype(np.int64) + 1) - extra - 1
    data = np.zeros(len(codes) + int(extra.sum(dtype=np.int64)), dtype=np.uint8)
    for byte in range(4):
        has = extra >= byte
        if not has.any():
            break
        data[at[has] + byte] = codes[has] >> np.uint32(8 * byte) & np.uint32(0xFF)
    quads = np.pad(extra, (0, -len(extra) % 4)).reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_codes(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = LENGTHS[control].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    codes = data[at].astype(np.uint32)
    for byte in range(1, 4):
        has = np.flatnonzero(lengths > byte)
        if not len(has):
            break
        codes[has] |= data[at[has] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return codes


def encode_file(doc_ids: list, ids: list[np.ndarray]) -> list[bytes]:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    counts = np.bincount(flat)
    id_of = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())].astype("<u4")
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    control, data = encode_codes(rank_of[flat])
    return [
        MAGIC + struct.pack(HEAD, len(doc_ids), len(flat), len(id_of)),
        id_of.tobytes(),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.array([len(x) for x in ids], dtype="<u4").tobytes(),
        control,
        data,
    ]


def decode_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Doc ids, ids per document, and all ids of a file."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file of this format")
    n_docs, n_ids, n_ranks = struct.unpack_from(HEAD, content, 4)
    at = 4 + struct.calcsize(HEAD)
    id_of = np.frombuffer(content, "<u4", n_ranks, at)
    docs = np.frombuffer(content, "<i8", n_docs, at := at + 4 * n_ranks)
    nulls = np.frombuffer(content, np.uint8, n_docs, at := at + 8 * n_docs)
    sizes = np.frombuffer(content, "<u4", n_docs, at := at + n_docs)
    control = np.frombuffer(content, np.uint8, -(-n_ids // 4), at := at + 4 * n_docs)
    data = np.frombuffer(content, np.uint8, offset=at + len(control))
    ids = id_of[decode_codes(control, data, n_ids)]
    return [None if z else int(d) for d, z in zip(docs, nulls, strict=True)], sizes, ids


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, ids_per_file: int = 1_500_000, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs in ascending doc_id order (null first, repeated ids by text) into files in `folder`, which all
    executors reach. Null text counts as empty, and each document ends with the end id. An empty table writes no file.
    Texts are dealt by doc_id range and tokenised once. Returns the table file (without suffix), n_docs, n_ids."""
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return write_files(in_order(rows, ids_per_file), vocabulary, folder, ids_per_file, lambda d, i: {SUFFIX: encode_file(d, i)})


def read_token_files(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path")

    def sizes(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, local = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(local) as f:
                    n_ids = struct.unpack_from(HEAD, f.read(4 + struct.calcsize(HEAD)), 4)[1]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n_ids], pa.int64())], names=["path", "n_ids"])

    placed = bases(materialise(files.mapInArrow(sizes, "path string, n_ids long"), "token-file-sizes"), "path", F.col("n_ids"))

    def decode(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, local = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(local) as f:
                    docs, n, ids = decode_file(f.read())
                ends = np.cumsum(n, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + ends - n), pa.array(n.astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one file a task, so that a lost one is read again alone
    spread = max(1, files.count())
    return placed.select("path", "base").repartition(spread, "path").mapInArrow(decode, DECODED)


def binary_output_query(docs: DataFrame) -> DataFrame:
    """Contract of op5: encode every document, then report each from the files."""
    folder = scratch(docs.sparkSession, "token-files")
    write_token_files(docs, vocabulary_path("byte_bpe_50k.json"), folder)
    return read_token_files(docs.sparkSession, folder)
