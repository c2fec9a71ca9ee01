"""Positions of pieces of a text as array expressions, in less than quadratic time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; in a lambda it would be once per element."""
    return F.transform(F.array(value), body)[0]


def positions(steps: Column) -> Column:
    """Array of (start, end) from an array of (gap, len): what lies before each piece, from the last one on, and its length.

    Steps are dealt into blocks of the root of their number: appending copies an array, so the work is
    the number times its root, not its square.
    """
    return let(steps, lambda whole: let(_blocks(whole), _block_spans))


def _blocks(steps: Column) -> Column:
    n = F.size(steps)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    count = F.greatest(F.lit(1), F.ceil(n / width).cast("int"))
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(steps, (i - 1) * width + 1, width))


def _block_spans(blocks: Column) -> Column:
    whole = lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + s["gap"] + s["len"])

    def span(a: Column, s: Column) -> Column:
        start = a["at"] + s["gap"]
        return F.array(F.struct(start.alias("start"), (start + s["len"]).alias("end")))

    def inner(block: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        grow = lambda a, s: F.struct((a["at"] + s["gap"] + s["len"]).alias("at"), F.concat(a["spans"], span(a, s)).alias("spans"))
        return F.aggregate(block, zero, grow, lambda a: a["spans"])

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        blocks, begin, lambda a, b: F.struct((a["at"] + whole(b)).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"]
    )
    return F.flatten(F.zip_with(blocks, starts, inner))
