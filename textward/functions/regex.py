"""Translation of the pattern database's regular expressions to Java's dialect, on the driver."""

from __future__ import annotations

#: What counts as white space in patterns and when trimming: ASCII white space, no-break space, byte-order mark,
#: line and paragraph separators, and the space separators.
SPACES = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def to_java(regex: str, flags: str = "") -> str:
    """Same matches under java.util.regex: own white-space class, ASCII word boundaries, [^] as any character, braces
    around code points, and '[' and '&' inside classes taken literally."""
    out, i, inside, opened = [], 0, False, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\" and i + 1 < len(regex):
            n = regex[i + 1]
            if n == "s":
                out.append(SPACES if inside else f"[{SPACES}]")
            elif n == "S":
                # a negated class nested in a class is a union in Java, as meant
                out.append(f"[^{SPACES}]")
            elif n == "b" and not inside:
                out.append(_BOUNDARY)
            elif n == "u" and regex[i + 2 : i + 3] == "{":
                end = regex.index("}", i)
                out.append("\\x" + regex[i + 2 : end + 1])
                i = end + 1
                continue
            else:
                out.append(c + n)
            i += 2
            continue
        if not inside and c == "[":
            if regex.startswith("[^]", i):
                out.append(r"[\x{0}-\x{10FFFF}]")
                i += 3
                continue
            inside, opened = True, len(out)
        elif inside and c == "]" and len(out) > opened + 1:
            inside = False
        elif inside and c in "[&":
            out.append("\\")
        out.append(c)
        i += 1
    prefix = "".join(f for f in "im" if f in flags)
    return (f"(?{prefix})" if prefix else "") + "".join(out)
