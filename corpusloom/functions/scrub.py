"""Replacing whatever any of several patterns match."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ._parts import in_parts
from ._regex import columns, compiled, translate

REPLACEMENT = "REDACTED"


def scrubbed(text: str, patterns: Sequence[str], replacement: str) -> str:
    """One text with the union of all matches replaced; overlapping and touching matches are one."""
    found = sorted(m.span() for p in patterns for m in compiled(p).finditer(text))
    if not found:
        return text
    out, done, stop = [], 0, None
    for a, b in found:
        if stop is None:
            out.append(text[done:a])
            stop = b
        elif a <= stop:
            stop = max(stop, b)
        else:
            out += [replacement, text[stop:a]]
            stop = b
    return "".join([*out, replacement, text[stop:]])


def scrub(expr: Column | str, *, patterns: Sequence[str], replacement: str = REPLACEMENT) -> Column:
    """The text with all matches of all patterns replaced literally; null for null, unchanged without patterns."""
    wanted = tuple(patterns)
    for p in wanted:
        translate(p)
    if not wanted:
        return columns(expr)

    def clean(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else scrubbed(t, wanted, replacement) for t in text.to_pylist()], pa.string())

    return F.arrow_udf(in_parts(clean), "string")(columns(expr))


def scrub_native(expr: Column | str, *, patterns: Sequence[str], replacement: str = REPLACEMENT) -> Column:
    """``scrub`` from built-in functions alone, for plans that must stay in the JVM (ASCII patterns, no empty match)."""
    text = columns(expr)
    spans = F.array().cast("array<struct<a:int,b:int>>")
    for p in patterns:
        java = translate(p).java
        hits = F.regexp_extract_all(text, F.lit(java), F.lit(0))
        gaps = F.split(text, java, -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

        def step(acc, x):
            a = acc["at"] + F.length(x["gap"])
            b = a + F.length(x["hit"])
            return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("a"), b.alias("b")))).alias("out"))

        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
        #: Most patterns stand in few texts: one search saves taking all others apart.
        spans = F.concat(spans, F.when(F.regexp_like(text, F.lit(java)), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<a:int,b:int>>")))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"), F.lit(-1).alias("stop"))

    def join(acc, x):
        touches = x["a"] <= acc["stop"]
        fresh = F.concat(acc["out"], F.when(acc["stop"] >= 0, F.lit(replacement)).otherwise(""), F.substr(text, F.greatest(acc["stop"], F.lit(0)) + 1, x["a"] - F.greatest(acc["stop"], F.lit(0))))
        return F.struct(F.when(touches, acc["out"]).otherwise(fresh).alias("out"), acc["done"].alias("done"), F.greatest(acc["stop"], x["b"]).alias("stop"))

    def finish(acc):
        return F.when(acc["stop"] < 0, text).otherwise(F.concat(acc["out"], F.lit(replacement), F.substr(text, acc["stop"] + 1, F.length(text))))

    return F.when(text.isNotNull(), F.aggregate(F.array_sort(spans), begin, join, finish))
