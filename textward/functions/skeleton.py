"""Unicode skeletons: look-alike and compatibility characters folded, invisible ones dropped, with an offset map.

Only texts that hold such a character leave the JVM: a translate() over the active code points decides.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cross-script look-alikes and their Latin letters, and code points dropped entirely.
# fmt: off
CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ɡ": "g", "А": "A", "В": "B", "Е": "E", "К": "K",
    "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I",
    "Ѕ": "S", "Ј": "J", "α": "a", "ο": "o", "ε": "e", "ρ": "p", "ν": "v", "ι": "i", "κ": "k",
    "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# fmt: on
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\ufeff"
SELECTORS = [(0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]


def fold(c: str) -> str:
    """The skeleton of one character: compatibility form, then look-alikes; '' if dropped."""
    if c < "\x80":
        return c
    if c in INVISIBLE or any(a <= ord(c) <= b for a, b in SELECTORS):
        return ""
    return "".join(CONFUSABLES.get(x, x) for x in unicodedata.normalize("NFKC", c))


@cache
def active_characters() -> str:
    """All characters that fold() changes."""
    return "".join(chr(k) for k in range(0x80, sys.maxunicode + 1) if not 0xD800 <= k < 0xE000 and fold(chr(k)) != chr(k))


class _Folds(dict):
    """fold() of every code point seen so far, as str.translate() takes it."""

    def __missing__(self, code: int) -> str:
        self[code] = out = fold(chr(code))
        return out


_FOLDS = _Folds()


def skeleton_of(text: str) -> tuple[str, list[int]]:
    """The skeleton and, for each of its characters, the position in text it came from."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.ones(len(codes), np.int32)
    high = np.flatnonzero(codes >= 0x80)
    sizes[high] = [len(_FOLDS[c]) for c in codes[high].tolist()]
    return text.translate(_FOLDS), np.repeat(np.arange(len(codes), dtype=np.int32), sizes).tolist()


def is_folded(text: Column) -> Column:
    """True where the skeleton differs from the text."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.length(F.translate(text, active_characters(), "")) < F.length(text)).otherwise(False)


@F.pandas_udf(T.StructType([T.StructField("skeleton", T.StringType()), T.StructField("places", T.ArrayType(T.IntegerType()))]))
def _skeletons(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else skeleton_of(t) for t in texts]
    return pd.DataFrame(rows, columns=["skeleton", "places"])


def skeleton(text: Column) -> Column:
    """struct(skeleton, places) of texts that change, null for the others (which never reach Python)."""
    return _skeletons(F.when(is_folded(text), text))


def original_span(places: Column, n: Column, start: Column, size: Column) -> Column:
    """struct(offset, length) in the text of a span of its skeleton; dropped characters after the span's last
    character and before the next kept one belong to it. n: length of the text."""
    count = F.size(places)
    first = F.when(start >= count, n).otherwise(F.get(places, start))
    last = F.get(places, F.least(start + size, count) - 1)
    end = F.coalesce(F.get(F.filter(F.slice(places, F.least(start + size, count) + 1, count), lambda p: p > last), F.lit(0)), n)
    return F.when((start >= count) | (size <= 0), F.struct(first.alias("offset"), F.lit(0).alias("length"))).otherwise(F.struct(first.alias("offset"), (end - first).alias("length")))
