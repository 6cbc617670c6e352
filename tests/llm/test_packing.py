import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textward.llm.packing import binary_lengths, pack_documents
from textward.llm.tokens import END_ID, TextEncoder, vocabulary_path


ENCODERS = {}


def library_ids(path):
    """text -> ids by a fresh tokenizer, as the library gives them."""
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids

DOCS = [
    (1, "Of the inanin. Thonst 'tis don't 123 a\nb", "x"),
    (2, None, "x"),
    (3, "", "x"),
    (4, "  lead  and\n\ntail   nbsp　wide é ", "x"),
    (4, "  lead  and\n\ntail   nbsp　wide é ", "x"),
    (5, "word " * 9000 + "end", "x"),
    (None, "null id <|endoftext|> x", "x"),
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_equal_whole_text(name, spark, sf_dir):
    enc, want = TextEncoder(vocabulary_path(name)), library_ids(vocabulary_path(name))
    texts = [t for _, t, _ in DOCS if t] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    texts += ["a \tb", "x\n\ny", "x \n y", "İstanbul Ångström", "a­ b", "tab\tx y", "l'été d'être it's we'll"]
    texts += ["a <|endoftext|> b", "x<|startoftext|>", "<|endoftext", "stop... 'quoted', (so) rock'n'roll, it's' we'll! 5, a1, é, éa. ù***", "zero\0in it, \0 x"]
    for text in texts:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want(text), text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abcAZé'.,*!-19 \n\t\u00a0\u0301İΣσß<|>endoftx", max_size=9), max_size=8).map(" ".join))
def test_pieces_equal_whole_text_of_odd_characters(name, text):
    if name not in ENCODERS:
        ENCODERS[name] = TextEncoder(vocabulary_path(name)), library_ids(vocabulary_path(name))
    enc, want = ENCODERS[name]
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == want(text)


def test_escaped_special_tokens():
    enc = TextEncoder(vocabulary_path("byte_bpe_50k.json"), escaped=True)
    assert 50256 not in np.frombuffer(enc.encode("a <|endoftext|> b"), "<u4") and 50256 in library_ids(vocabulary_path("byte_bpe_50k.json"))("a <|endoftext|> b")


def test_binary_lengths():
    assert binary_lengths(11, 4) == [4, 4, 2, 1]
    assert binary_lengths(4096, 4096) == [4096]
    assert binary_lengths(0, 8) == []


def test_pieces_cover_each_document(spark):
    path = vocabulary_path("word_bpe_49k.json")
    got = pack_documents(spark.createDataFrame(DOCS, "doc_id long, text string, start string"), path, longest=1024).collect()
    ids_of = library_ids(path)
    want = {i: np.append(ids_of(t or ""), END_ID).astype("<u4") for i, t, _ in DOCS}
    assert len({r.sequence_id for r in got}) == len(got)
    for doc, ids in want.items():
        rows = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        times = 2 if doc == 4 else 1
        assert sum(r.length for r in rows) == times * len(ids)
        for r in rows:
            part = ids[r.start : r.start + r.length]
            assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.ids == part.tolist() and r.doc_tokens == len(ids)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(docs, vocabulary_path("word_bpe_49k.json")).count() == 0


def test_length_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        pack_documents(spark.createDataFrame(DOCS, "doc_id long, text string, start string"), "x", longest=1000)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_encoded_together(name):
    """Of many texts each distinct piece is looked up once, whatever stands beside it, and each has the library's ids."""
    rng = random.Random(3)
    parts = ["a", "B", "don't", "a,b,.", "it.s,", "Word", "end...", "x1", " ", " ", " ", "\n", "  ", "\t", "é", "ß", "中", "́", "\xa0", "!!", "....?", "[UNK]", "</s>", "<|endoftext|>"]
    texts = [None, "", " ", "\n", "a ", "\na", "", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500))]
    path = vocabulary_path(name)
    enc = TextEncoder(path)
    for cut in (pa.array(texts), pa.array(texts).slice(5), pa.array(texts).slice(0, 1), pa.array([], pa.string())):
        whole = [np.append(np.frombuffer(enc.encode_whole(t or ""), "<u4"), 2).tolist() for t in cut.to_pylist()]
        assert [x.tolist() for x in enc.encode_all(cut, 2)] == whole
    plain = TextEncoder(path)
    made, plain._keys._make = [], (lambda make: lambda key: made.append(key) or make(key))(plain._keys._make)
    plain.encode_all(pa.array(["one two, two one\ntwo" for _ in range(50)]), 2)
    assert sorted(made) == [b"\ntwo", b" one", b" two", b",", b"one"]
