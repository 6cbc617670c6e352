"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two, largest first. Pieces of one length form a
bucket; every piece is a sequence of its own, so no sequence crosses documents and none is padded. Batches are drawn
from one bucket at a time.

The operator is one pass over the texts without a shuffle: memory is one Arrow batch, and a lost task is redone alone
with the same sequence ids, which come from the partition and a counter in it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import id_batches, vocabulary_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, ids array<int>"


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as whole longest pieces and then its remaining binary digits, largest first."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, vocabulary: str, longest: int = 4096, doc_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece of each document's ids (text through `vocabulary`, then the end id).

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0: one piece a sequence),
    bucket (log2 of length), ids. `longest` must be a power of two and also caps the length of a sequence.
    Null or empty text: one piece with the end id alone. Null doc_id: kept as null. Repeated rows: each is packed.
    Extra columns are ignored. An empty table gives no rows.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = PIECES if with_ids else PIECES.removesuffix(", ids array<int>")

    def pack(batches):
        part, made = TaskContext.get().partitionId(), 0
        for rows in id_batches(batches, vocabulary):
            out: list[list] = [[] for _ in range(9)]
            for doc, ids in rows:
                start = 0
                for length in binary_lengths(len(ids), longest):
                    piece = ids[start : start + length]
                    values = (doc, start, length, zlib.crc32(piece.tobytes()), len(ids), part << 40 | made, 0, length.bit_length() - 1, piece)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    start, made = start + length, made + 1
            columns = [pa.array(c, pa.int64()) for c in out[:7]] + [pa.array(out[7], pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                ends = np.cumsum([0, *out[2]], dtype=np.int64)
                flat = pa.array(np.concatenate(out[8]).astype(np.int32)) if out[8] else pa.array([], pa.int32())
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, schema)


def packing_query(docs: DataFrame) -> DataFrame:
    """Contract of op1: every document, word BPE, sequences of at most 4096 ids."""
    return pack_documents(docs, vocabulary_path("word_bpe_49k.json"), with_ids=False)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences by bucket, so that a training job reads equal lengths together."""
    pieces.write.partitionBy("bucket").parquet(path)
