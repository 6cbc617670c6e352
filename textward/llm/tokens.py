"""Exact, fast use of a public tokenizer file on the executors.

Byte-level and word BPE never merge across a lone blank or line break that stands between two printing characters,
so a text can be cut there, each distinct piece encoded once by the tokenizers library, and the ids joined again.
Texts with other white space, and those that hold a special token's text, are encoded whole. Pieces are cut on the
bytes of many texts at a time and told apart by Arrow, so Python sees each distinct one once.
tests/llm/test_packing.py holds all of it against a tokenizer of its own.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Split pattern of byte-level BPE, a fixed value of that scheme.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Appended to each document by the packing and binary-output operators.
END_ID = 2
#: Pieces kept per worker and table: the newest so many, and of the same number before them those asked for since.
#: Memory is bounded (about 80 MB for 200,000 pieces).
PIECES_KEPT, WORDS_KEPT = 250_000, 50_000

#: Text bytes (beyond a longer document) that are encoded at a time.
BYTES_AT_A_TIME = 4_000_000

#: A piece may be cut off only where printing characters stand on both sides.
_PLAIN = frozenset(chr(k) for a, b in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0x24F)) for k in range(a, b + 1))
_ASCII_MARKS = "".join(chr(k) for k in range(0x21, 0x7F) if not chr(k).isalnum())
#: Pieces of only these need neither composing nor special lower-casing.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]*")


def _byte_letters() -> dict[int, str]:
    """The letters byte-level BPE writes bytes as: printing Latin-1 bytes as themselves, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTER = np.array([k < 128 and chr(k).isalpha() for k in range(256)])
_MARK = np.array([chr(k) in _ASCII_MARKS for k in range(256)])


class _UnusualWhite(Exception):
    """A text has white space that may be part of a token."""


class _Pieces(dict):
    """Piece -> its ids as little-endian uint32 bytes, made when first asked for."""

    def __init__(self, make, kept: int = PIECES_KEPT):
        super().__init__()
        self._make, self._kept, self._before = make, kept, {}

    def __missing__(self, piece):
        if len(self) >= self._kept:
            self._before = dict(self)
            self.clear()
        ids = self._before.get(piece)
        if ids is None:
            ids = self._make(piece)
        self[piece] = ids
        return ids


class TextEncoder:
    """encode(text) -> ids as little-endian uint32 bytes, equal to the library's ids of the whole text.

    A new piece is cut into words by the tokenizer file's own split pattern and each new word goes through the
    library's merge model; pieces with unusual characters, and texts with unusual white space, go through the library
    whole. `escaped`: special tokens' texts are encoded like any other text."""

    def __init__(self, vocabulary: str, escaped: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._tokenizer.encode_special_tokens = escaped
        self._tokenize = self._tokenizer.model.tokenize
        with open(vocabulary, encoding="utf-8") as f:
            parts = json.load(f)
        self._special = [] if escaped else [t["content"] for t in parts["added_tokens"]]
        split = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self._lower = split is not None
        self._split = regex.compile(split or BYTE_LEVEL_SPLIT).findall
        self._letters = _byte_letters()
        self._words = _Pieces(self._encode_word, WORDS_KEPT)
        self._keys = _Pieces(self._encode_key)
        # a line break alone between printing characters is a token, or is dropped as white space
        self._break = self.encode_whole("a\nb")[4:-4]

    def encode_whole(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _encode_word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._letters)
        elif word[0] == " ":
            word = self._letters[32] + word[1:]
        return array("I", [t.id for t in self._tokenize(word)]).tobytes()

    def _encode_piece(self, piece: str, blank: str) -> bytes:
        core = piece.rstrip(_ASCII_MARKS)
        if core.isascii() and core.isalpha():
            ids = self._words[core.lower() if self._lower else blank + core]
            return ids + self._words[piece[len(core) :]] if len(core) < len(piece) else ids
        if not piece or piece[0] not in _PLAIN or piece[-1] not in _PLAIN:
            raise _UnusualWhite
        if not _SIMPLE.fullmatch(piece):
            return self.encode_whole(blank + piece)
        piece = blank + piece
        return b"".join(map(self._words.__getitem__, self._split(piece.lower() if self._lower else piece)))

    def _encode_key(self, key: bytes) -> bytes | None:
        """Ids of a piece with the blank or line break before it; None if a text with it must go through the library."""
        mark, piece = (key[:1], key[1:]) if key[0] in b" \n" else (b"", key)
        if piece.isalpha():  # of bytes: ASCII letters
            word = piece.decode()
            if self._lower:
                ids = self._words[word.lower()]
            else:
                ids = array("I", [t.id for t in self._tokenize(self._letters[32] + word if mark == b" " else word)]).tobytes()
        else:
            try:
                ids = self._encode_piece(piece.decode(), " " if mark == b" " else "")
            except _UnusualWhite:
                return None
        return self._break + ids if mark == b"\n" else ids

    def encode_all(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text (a null one is empty) and the end id, as arrays of little-endian uint32."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        base, ends = ends[0], ends[1:] - ends[0]
        raw = texts.buffers()[2]
        raw = np.frombuffer(raw, np.uint8, ends[-1] if len(ends) else 0, base) if raw else np.zeros(0, np.uint8)
        starts = np.concatenate([[0], ends[:-1]])
        # pieces begin at a text's start and at its blanks and line breaks; an empty piece after each text is its end
        inner = (raw == 32) | (raw == 10)
        filled = starts[starts < ends]
        odd = np.zeros(len(texts), bool)
        odd[starts < ends] = inner[filled]
        inner[filled] = True
        # and where up to three ASCII marks that end a piece follow an ASCII letter: those never share a token
        marks = _MARK[raw]
        closing = marks & np.append(inner[1:], True)
        for _ in range(2):
            closing |= marks & np.append(closing[1:], False)
        closing[1:] &= _LETTER[raw[:-1]]
        inner[1:] |= closing[1:]
        cuts = np.flatnonzero(inner)
        last = np.searchsorted(cuts, ends) + np.arange(len(ends))
        offsets = np.append(np.insert(cuts, last - np.arange(len(ends)), ends), len(raw))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        at = coded.indices.to_numpy()
        end = np.array([end_id], "<u4").tobytes()
        known = self._keys
        ids = [known[key] if key else end for key in coded.dictionary.to_pylist()]
        unusual = np.array([x is None for x in ids], bool)
        if unusual.any():
            odd[np.searchsorted(last, np.flatnonzero(unusual[at]))] = True
            ids = [x or b"" for x in ids]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, places = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        counts = sizes[at]
        upto = np.cumsum(counts)
        chosen = np.repeat(places[at] - (upto - counts), counts)
        chosen += np.arange(len(chosen))
        flat = pool[chosen]
        out = np.split(flat, upto[last[:-1]]) if len(last) else []
        whole = raw.tobytes() if self._special else b""
        for special in (x.encode() for x in self._special):
            if special in whole:
                odd |= np.array([special in text for text in texts.to_pylist()], bool)
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.frombuffer(self.encode_whole(texts[k].as_py().decode()) + end, "<u4")
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]), END_ID)[0][:-1].tobytes()


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def encoder(vocabulary: str, escaped: bool = False) -> TextEncoder:
    """One encoder a worker process; Spark reuses workers, so pieces stay warm between tasks."""
    if (vocabulary, escaped) not in _ENCODERS:
        _ENCODERS[vocabulary, escaped] = TextEncoder(vocabulary, escaped)
    return _ENCODERS[vocabulary, escaped]


def vocabulary_path(name: str) -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_batches(batches: Iterator, vocabulary: str, end_id: int = END_ID, rows: int = 4096, escaped: bool = False) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """(doc_id, ids with the end id) for Arrow batches of (doc_id, text), some BYTES_AT_A_TIME of text and at most so
    many documents at a time."""
    enc = encoder(vocabulary, escaped)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            size = np.cumsum(pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy(zero_copy_only=False))
            part = part.slice(0, max(1, int(np.searchsorted(size, BYTES_AT_A_TIME, side="right"))))
            at += part.num_rows
            yield list(zip(part.column(0).to_pylist(), enc.encode_all(part.column(1), end_id), strict=True))
