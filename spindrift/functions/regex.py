"""From linear-time (RE2-style) regular expressions to the JVM's: same matches, or a refusal.

Differences that matter: case folding is Unicode-wide, ``$`` is the end of the text only, named classes
are written differently, and what the linear-time syntax lacks (look-around, back references, possessive
quantifiers, atomic groups) must be refused, not run.
"""

from __future__ import annotations

import re

# Bracket class names and their JVM spellings.
NAMED = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}",
    "space": r"\p{Space}", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}
_ESCAPES = set("abfnrtvdDsSwWBAzQECxpP01234567")
_GROUP = re.compile(r"\(\?(?:P?<(?P<name>[A-Za-z_]\w*)>|(?P<flags>[imsU]*(?:-[imsU]+)?)(?P<end>[:)]))")
_REPEAT = re.compile(r"\{(\d+)(?:(,)(\d*))?\}")


class Unsupported(ValueError):
    """The pattern is not one that a linear-time engine takes."""


def translate(pattern: str) -> str:
    """The JVM pattern of a case-insensitive linear-time pattern; raises ``Unsupported``."""
    out, i, depth, n = [], 0, 0, len(pattern)
    quantifiable = False
    while i < n:
        c = pattern[i]
        if c == "\\":
            piece, i = _escape(pattern, i)
            out.append(piece)
            quantifiable = piece not in (r"\b", r"\B", r"\A", r"\z")
        elif c == "[":
            piece, i = _bracket(pattern, i)
            out.append(piece)
            quantifiable = True
        elif c == "(":
            depth += 1
            if pattern.startswith("(?", i):
                m = _GROUP.match(pattern, i)
                if not m or m["flags"] and "U" in m["flags"]:
                    raise Unsupported("group")
                if m["name"]:
                    out.append(f"(?<{m['name'].replace('_', '')}>" if m["name"].replace("_", "").isalnum() else "(")
                elif m["end"] == ")":
                    depth -= 1
                    out.append(m.group())
                else:
                    out.append(m.group())
                i = m.end()
            else:
                out.append("(")
                i += 1
            quantifiable = False
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise Unsupported("closing parenthesis")
            out.append(c)
            i += 1
            quantifiable = True
        elif c in "*+?" or c == "{" and _REPEAT.match(pattern, i):
            if not quantifiable:
                raise Unsupported("nothing to repeat")
            if c == "{":
                m = _REPEAT.match(pattern, i)
                lo, hi = int(m[1]), int(m[3]) if m[3] else int(m[1])
                if max(lo, hi) > 1000 or m[3] and hi < lo:
                    raise Unsupported("repeat count")
                i = m.end()
                out.append(m.group())
            else:
                i += 1
                out.append(c)
            if i < n and pattern[i] == "?":
                out.append("?")
                i += 1
            quantifiable = False  # a second quantifier would be possessive or an error
        else:
            out.append({"$": r"\z", "{": r"\{", "}": r"\}", "]": r"\]"}.get(c, c))
            i += 1
            quantifiable = c not in "|^$"
    if depth:
        raise Unsupported("open parenthesis")
    return "(?iu)" + "".join(out)


def _escape(p: str, i: int) -> tuple[str, int]:
    if i + 1 >= len(p):
        raise Unsupported("trailing backslash")
    c = p[i + 1]
    if c == "Q":
        end = p.find("\\E", i + 2)
        text = p[i + 2 : end if end >= 0 else len(p)]
        return re.sub(r"([^\w\s])", r"\\\1", text), (end + 2 if end >= 0 else len(p))
    if c == "x":
        m = re.compile(r"\\x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]{1,6})\})").match(p, i)
        if not m:
            raise Unsupported("hexadecimal escape")
        return m.group(), m.end()
    if c in "pP":
        m = re.compile(r"\\[pP](?:[A-Z]|\{\^?[A-Za-z_]+\})").match(p, i)
        if not m:
            raise Unsupported("class name")
        return m.group(), m.end()
    if c == "C" or c in "123456789":
        raise Unsupported("escape")
    if c == "0":
        m = re.compile(r"\\0[0-7]{0,2}").match(p, i)
        return f"\\x{{{int(m.group()[1:], 8):x}}}", m.end()
    if c == "v":
        return r"\x0B", i + 2
    if c == "b":
        return r"\b", i + 2
    if c == "s":
        return r"[\t\n\f\r ]", i + 2
    if c == "S":
        return r"[^\t\n\f\r ]", i + 2
    if c.isalnum() and c not in _ESCAPES:
        raise Unsupported("escape")
    return "\\" + c, i + 2


def _bracket(p: str, i: int) -> tuple[str, int]:
    j, out = i + 1, ["["]
    if p.startswith("^", j):
        out.append("^")
        j += 1
    first = True
    while True:
        if j >= len(p):
            raise Unsupported("open bracket")
        c = p[j]
        if c == "]" and not first:
            return "".join(out) + "]", j + 1
        first = False
        if p.startswith("[:", j):
            m = re.compile(r"\[:(\^?)(\w+):\]").match(p, j)
            if not m or m[2] not in NAMED:
                raise Unsupported("class name")
            out.append(f"[^{NAMED[m[2]]}]" if m[1] else NAMED[m[2]])
            j = m.end()
        elif c == "\\":
            piece, j = _escape(p, j)
            if piece == r"\b":
                raise Unsupported("escape in brackets")
            out.append(piece)
        else:
            if p[j + 1 : j + 2] == "-" and p[j + 2 : j + 3] not in ("]", "", "\\") and p[j + 2] < c:
                raise Unsupported("range")
            out.append("\\" + c if c in "[]&~" else c)
            j += 1
