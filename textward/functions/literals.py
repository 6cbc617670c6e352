"""Literals that every match of a regular expression holds, for ruling texts out by plain substring search."""

from __future__ import annotations

import re
from functools import cache
from re import _parser as parser

#: Strings a run of literals may stand for, groups of literals asked for a pattern, and length that is long enough.
MOST_STRINGS, MOST_GROUPS, LONG = 24, 3, 4
Group = frozenset[str]


def _worth(group: Group) -> tuple[int, int]:
    """Long literals rule out most, and few of them are searched soonest."""
    return min(LONG, *map(len, group)), -len(group)


class _Walk:
    """Finds groups of strings in a parsed expression; every match holds at least one string of each group."""

    def _char(self, code: int) -> Group | None:
        c = chr(code)
        if code >= 0x80:
            return None
        return frozenset([c.lower()])

    def _exact(self, op, arg) -> Group | None:
        """All strings the item matches, lower-cased, if they are few and ASCII."""
        name = str(op)
        if name == "LITERAL":
            return self._char(arg)
        if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            chars = [self._char(a) for _, a in arg]
            return None if None in chars else frozenset().union(*chars)
        if name == "AT":
            return frozenset([""])
        if name == "SUBPATTERN":
            return self._exact_all(arg[3])
        if name == "BRANCH":
            each = [self._exact_all(b) for b in arg[1]]
            return None if None in each else frozenset().union(*each)
        if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1):
            inner = self._exact_all(arg[2])
            return None if inner is None else inner | {""}
        return None

    def _exact_all(self, items) -> Group | None:
        out = frozenset([""])
        for op, arg in items:
            one = self._exact(op, arg)
            if one is None or len(out) * len(one) > MOST_STRINGS:
                return None
            out = frozenset(a + b for a in out for b in one)
        return out

    def groups(self, items) -> list[Group]:
        out, run = [], frozenset([""])

        def close():
            if "" not in run:
                out.append(run)

        for op, arg in items:
            one = self._exact(op, arg)
            if one is not None and len(run) * len(one) <= MOST_STRINGS:
                run = frozenset(a + b for a in run for b in one)
                continue
            close()
            run = one if one is not None else frozenset([""])
            if one is None:
                out.extend(self._inner(str(op), arg))
        close()
        return out

    def _inner(self, name: str, arg) -> list[Group]:
        if name == "SUBPATTERN":
            return self.groups(arg[3])
        if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            return self.groups(arg[2])
        if name == "BRANCH":
            best = [max(self.groups(b), key=_worth, default=None) for b in arg[1]]
            return [] if None in best else [frozenset().union(*best)]
        return []


def _without_parts(group: Group) -> Group:
    """Without strings that hold another one of the group."""
    return frozenset(s for s in group if not any(t != s and t in s for t in group))


@cache
def required(regex: str, flags: str = "") -> tuple[tuple[str, ...], ...]:
    """Groups of lower-case ASCII strings: a text with a match holds, lower-cased, a string of each group. Empty if the
    expression has none or cannot be read, so that its texts are always searched."""
    try:
        parsed = parser.parse(regex.replace("[^]", r"[\s\S]"), re.IGNORECASE if "i" in flags else 0)
    except (re.error, OverflowError):
        return ()
    groups = {_without_parts(g) for g in _Walk().groups(parsed)}
    best = sorted(groups, key=lambda g: (_worth(g), sorted(g)), reverse=True)
    return tuple(tuple(sorted(g)) for g in best[:MOST_GROUPS])
