"""Globs as anchored regular expressions, compiled on the driver.

`*` stays in a path segment, a whole segment `**` crosses any number, `?` is one character, classes take `!` or `^`,
braces with a comma are alternatives, and a backslash takes the next character literally.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set(".+^${}()|[]\\*?&")


def normalize_path(path: str) -> str:
    path = re.sub("/{2,}", "/", path)
    path = re.sub(r"^(\./)+", "", path)
    return path[:-1] if len(path) > 1 and path.endswith("/") else path


def normalized_path(path: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), r"^(\./)+", "")
    return F.when((F.length(path) > 1) & path.endswith("/"), F.left(path, F.length(path) - 1)).otherwise(path)


def _plain(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def _groups(glob: str):
    """(start, end, parts) of the first outermost brace group with a comma at its own level, or None."""
    depth, start, cuts, i = 0, 0, [], 0
    while i < len(glob):
        c = glob[i]
        if c == "\\":
            i += 2
            continue
        if c == "{":
            depth += 1
            if depth == 1:
                start, cuts = i, [i]
        elif c == "," and depth == 1:
            cuts.append(i)
        elif c == "}" and depth:
            depth -= 1
            if not depth and len(cuts) > 1:
                edges = [*cuts, i]
                return start, i, [glob[a + 1 : b] for a, b in zip(edges, edges[1:], strict=False)]
        i += 1
    return None


def expand_braces(glob: str) -> list[str]:
    found = _groups(glob)
    if found is None:
        return [glob]
    start, end, parts = found
    return [x for p in parts for x in expand_braces(glob[:start] + p + glob[end + 1 :])]


_CLASS = re.compile(r"\[([!^]?)(\]?(?:\\.|[^\]\\])*)\]", re.DOTALL)


def _segment(segment: str) -> str:
    out, i = [], 0
    while i < len(segment):
        c = segment[i]
        m = _CLASS.match(segment, i) if c == "[" else None
        if m:
            body = re.sub(r"\\.|[\^\[\]&\\]", lambda x: x[0] if len(x[0]) > 1 else "\\" + x[0], m[2], flags=re.DOTALL)
            out.append(f"[{'^' if m[1] else ''}{body}]")
            i = m.end()
            continue
        if c == "\\" and i + 1 < len(segment):
            i += 1
            out.append(_plain(segment[i]))
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or _plain(c))
        i += 1
    return "".join(out)


def _alternative(glob: str) -> str:
    parts = normalize_path(glob).split("/")
    if parts == ["**"]:
        return ".*"
    out = ""
    for i, p in enumerate(parts):
        if p == "**":
            out += "(?:/[^/]+)*" if i else "(?:[^/]+/)*"
        else:
            out += ("" if i == 0 or (i == 1 and parts[0] == "**") else "/") + _segment(p)
    return out


def to_regex(glob: str) -> str:
    """A regular expression that whole normalised paths match, for Python and Java alike."""
    return "^(?:" + "|".join(_alternative(g) for g in expand_braces(glob)) + ")$"


def match(glob: str, path: str) -> bool:
    return re.fullmatch(to_regex(glob)[1:-1], normalize_path(path)) is not None


def glob_match(path: Column, globs: list[str]) -> Column:
    """True where path matches any of globs."""
    path = normalized_path(path)
    test = F.lit(False)
    for g in globs:
        test = test | path.rlike(r"\A" + to_regex(g)[1:-1] + r"\z")
    return test
