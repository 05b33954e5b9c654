"""Predicates on type codes and names."""

from __future__ import annotations

from pyspark.sql import Column

#: Type codes: the low four bits say what a value is (1 to 7), the next two whether it is a set (16) or a list (32).
PRIMITIVES, CONTAINERS = range(1, 8), (0, 16, 32)


def type_is_valid(code: Column) -> Column:
    """Whether a type code names one primitive and at most one container."""
    return code.bitwiseAND(15).between(1, 7) & code.bitwiseAND(~15 & 0xFFFFFFF).isin(*CONTAINERS)


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for a pattern of *, ? and [sets]."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "^!" else body).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append("\\" + c if not c.isalnum() else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"
