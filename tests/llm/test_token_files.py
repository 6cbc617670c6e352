import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textward.llm.binary_output import decode_codes, encode_codes, read_token_files, write_token_files
from textward.llm.ordered_files import bases, make_folder, put_folder_file
from textward.llm.separator_scan import scan_flat_files, token_counts
from textward.llm.shared import scratch
from tests.llm.test_packing import library_ids
from textward.llm.tokens import END_ID, vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")
DOCS = [(3, "c # # c <|endoftext|> d", 1), (1, "It is. So\nit was", 2), (None, "no id", 3), (2, None, 4), (9, "", 5), (1, "It is. So\nit was", 6), (7, "ü longer " * 3000, 7)]
SCHEMA = "doc_id long, text string, n_tokens int"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_codes_round_trip(values):
    codes = np.array(values, dtype=np.uint32)
    control, data = encode_codes(codes)
    assert decode_codes(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(codes)).tolist() == values


def ordered():
    return sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0))


def test_files_round_trip(spark):
    folder = scratch(spark, "t")
    files = write_token_files(spark.createDataFrame(DOCS, SCHEMA), PATH, folder, ids_per_file=2000)
    assert files.count() > 2 and files.agg({"n_docs": "sum"}).first()[0] == len(DOCS)
    ids_of, start, want = library_ids(PATH), 0, []
    for doc, text, _ in ordered():
        ids = np.append(ids_of(text or ""), END_ID).astype("<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in read_token_files(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    folder = scratch(spark, "t")
    assert write_token_files(empty, PATH, folder).count() == 0
    assert read_token_files(spark, folder).count() == 0
    assert token_counts(empty, PATH, 50256).count() == 0


def test_token_counts(spark):
    tokenizer, start, want = Tokenizer.from_file(PATH), 0, []
    tokenizer.encode_special_tokens = True  # the separator's own text is not a separator
    for doc, text, _ in DOCS:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want.append((doc, start, n))
        start += n + 1
    got = [tuple(r) for r in token_counts(spark.createDataFrame(DOCS, SCHEMA), PATH, 50256).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_scan_stitches_blocks(spark):
    folder = scratch(spark, "flat")
    make_folder(folder)
    ids = np.array([5, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 1, 2], dtype="<u2")
    put_folder_file(f"{folder}/a.ids", ids.tobytes())
    put_folder_file(f"{folder}/b.ids", b"")
    for block in (1, 2, 3, 7, 100):
        got = sorted(tuple(r) for r in scan_flat_files(spark, folder, 0, block_ids=block).collect())
        assert got == [("a.ids", 0, 0, 1, True), ("a.ids", 1, 2, 0, True), ("a.ids", 2, 3, 9, True), ("a.ids", 3, 13, 2, False)]


def test_bases_in_two_levels(spark):
    rows = [(f"f/part-{p:07d}-{m:05d}.x", p + m + 1) for p in (0, 1, 9999, 10000, 25000) for m in range(3)]
    got = {r.path: r.base for r in bases(spark.createDataFrame(rows, "path string, n int"), "path", F.col("n")).collect()}
    assert got == {path: sum(n for other, n in rows if other < path) for path, _ in rows}
