"""Text expressions shared by search and extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for ``* ? [set] [!set]``; ``**`` is ``*``. Valid in Java, RE2 and Python."""
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        else:
            out.append(re.sub(r"([^A-Za-z0-9_/ ])", r"\\\1", c) if ord(c) < 128 else c)
        i += 1
    return "".join(out) + "$"


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("long")


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters plus 1.3 for each blank, rounded down."""
    return F.floor(F.length(text) * 0.25 + occurrences(text, " ") * 1.3).cast("long")


def snippet(text: Column, needle: str, radius: int = 60) -> Column:
    """Text around the first occurrence, with ellipses where it is cut; null without one."""
    at = F.instr(F.lower(text), needle.lower())
    start, end = F.greatest(at - radius, F.lit(1)), F.least(at + len(needle) + radius - 1, F.length(text))
    body = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, body)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two number arrays, in doubles; 0 where a vector is zero."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    square = lambda x: total(F.transform(x, lambda v: v.cast("double") * v.cast("double")))
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))
