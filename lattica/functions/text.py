"""Column expressions on text: whitespace, names, headings, relation types, JSON spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.constants import HEADING_PATTERNS, RELATION_TYPES, RELATION_VARIANTS

#: Every character that counts as white space, the information separators included.
SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Outer white space removed, line ends and wide spaces included."""
    return F.regexp_replace(text, f"{SPACE}+$|(?:\\A){SPACE}+", "")


def normalized_name(name: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(name), f"{SPACE}+", "")


def is_heading(line: Column) -> Column:
    """Whether a line reads as a section heading: short, and shouted or of a known form."""
    s = strip(line)
    shouted = (F.upper(s) == s) & (F.lower(s) != s) & F.length(s).between(5, 40)
    known = reduce(lambda a, b: a | b, (s.rlike(p) for p in HEADING_PATTERNS))
    return (s != "") & (F.length(s) <= 80) & (shouted | known)


def relation_type(raw: Column) -> Column:
    """The standard relation a raw type stands for, or its upper case where it stands for none."""
    up = F.upper(strip(raw))
    table = F.create_map(*(F.lit(x) for kv in RELATION_VARIANTS.items() for x in kv))
    valid = up.isin(RELATION_TYPES)
    head = F.split(up, "_")[0]
    inside = F.coalesce(*(F.when(F.contains(up, F.lit(t)), F.lit(t)) for t in sorted(RELATION_TYPES, key=lambda t: (-len(t), t))))
    return F.when(raw.isNull() | (raw == ""), "").otherwise(F.coalesce(table[up], F.when(valid, up), F.when(head.isin(RELATION_TYPES), head), inside, up))


def json_span(text: Column) -> Column:
    """The JSON object in a model's output: a fenced block's first, else from the first brace to the last; null without one."""
    bare = F.regexp_replace(text, "[﻿​‌‍]", "")
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    first, last = F.locate("{", bare), F.length(bare) - F.locate("}", F.reverse(bare)) + 1
    span = F.when((first > 0) & F.contains(bare, F.lit("}")) & (last > first), F.substring(bare, first, last - first + 1))
    return F.when(fenced != "", fenced).otherwise(span)


def json_repaired(span: Column) -> Column:
    """Trailing commas dropped and curly quotes made straight."""
    return F.translate(F.regexp_replace(span, r",\s*([}\]])", "$1"), "“”‘’", "\"\"''")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 for empty, unequal lengths or zero norms."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, t: s + t * t))
    scale = norm(x) * norm(y)
    return F.when((F.size(x) > 0) & (F.size(x) == F.size(y)) & (scale > 0), dot / scale).otherwise(F.lit(0.0))


def confidence(col: Column) -> Column:
    """A stored confidence, 1 where it is missing, NaN or zero."""
    return F.when(col.isNull() | F.isnan(col) | (col == 0), 1.0).otherwise(col)
