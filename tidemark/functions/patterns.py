"""SQL patterns as regular expressions."""

from __future__ import annotations

import re

#: Named character classes of SIMILAR TO (fixed values).
CLASSES = {"ALPHA": r"\p{Alpha}", "UPPER": r"\p{Upper}", "LOWER": r"\p{Lower}", "DIGIT": r"\d", "SPACE": " ", "WHITESPACE": r"\s", "ALNUM": r"\p{Alnum}"}


def like_to_regex(pattern: str, escape: str | None = None) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            if i + 1 >= len(pattern) or pattern[i + 1] not in ("%", "_", escape):
                raise ValueError(f"bad escape in {pattern!r}")
            out.append(re.escape(pattern[i + 1]))
            i += 1
        else:
            out.append(".*" if c == "%" else "." if c == "_" else re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def similar_to_regex(pattern: str, escape: str | None = None) -> str:
    """| * + ? {n,m} ( ) keep their meaning, [...] is a class (also [[:ALPHA:]]); everything else is literal."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            out.append("\\" + pattern[i + 1])
            i += 1
        elif inside and (named := re.match(r"\[:(\w+):\]", pattern[i:])):
            if named[1].upper() not in CLASSES:
                raise ValueError(f"unknown class {named[1]!r}")
            out.append(CLASSES[named[1].upper()])
            i += len(named[0]) - 1
        elif inside:
            inside = c != "]"
            out.append("\\\\" if c == "\\" else c)
        elif c == "[":
            inside = True
            out.append(c)
        elif c in "|*+?{}(),0123456789" or c.isalpha():
            out.append(c)
        else:
            out.append(".*" if c == "%" else "." if c == "_" else re.escape(c))
        i += 1
    if inside:
        raise ValueError(f"class without end in {pattern!r}")
    return "(?s)^(?:" + "".join(out) + ")$"
