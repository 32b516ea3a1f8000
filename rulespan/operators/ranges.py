"""Joins of points with the spans that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blocks(start: Column, stop: Column, top: int) -> Column:
    """The blocks of 2^level numbers that together are start..stop - 1, two a
    level at most: where the span begins or ends at the odd half of the next."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        a, b = F.ceil(start / size).cast("long"), F.floor(stop / size).cast("long")
        block = lambda cond, i: F.when((a < b) & cond, F.struct(level.alias("level"), i.alias("block")))
        return F.array(block(a % 2 == 1, a), block(b % 2 == 1, b - 1))

    levels = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top)), at))
    return F.filter(levels, lambda s: s.isNotNull())


def within(points: DataFrame, spans: DataFrame, key: str, at: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Every pair of a point and a span of the same ``key`` with
    start <= at < stop, without comparing a key's points with all its spans.

    A span is cut into blocks of powers of two, a point is in one block of each
    size, so the pairs meet in an equi join that makes no other rows.  Numbers
    are whole and not negative.  Columns of the two sides must differ but for
    ``key``; no spans give no rows.
    """
    longest = spans.agg(F.max(F.col(stop) - F.col(start))).first()[0]
    top = max(0, int(longest or 1).bit_length() - 1)
    cut = spans.withColumn("_b", F.explode(_blocks(F.col(start).cast("long"), F.col(stop).cast("long"), top)))
    cut = cut.select(*spans.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
    level = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_level")
    each = points.select(*points.columns, level).withColumn("_block", F.call_function("shiftright", F.col(at).cast("long"), F.col("_level")))
    return each.join(cut, [key, "_level", "_block"]).drop("_level", "_block")
