"""Joins of ranges that overlap, as equality joins on dyadic cells.

A range of n numbers has the level of the smallest power of two that is n at least, and so touches one or two cells of that size. Two ranges
meet on the cells of the larger level: the shorter one is entered at the levels that the other side has, the longer one at its own
alone. Each pair is told by the one cell in which its overlap begins, so none comes twice, and no pair of rows is compared that
doesn't share a cell of the longer one's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(first: Column, last: Column) -> Column:
    """The number of doublings of 1 that reach the range's length: binary digits of the length less one."""
    n = last - first
    return F.when(n <= 0, F.lit(0)).otherwise(F.length(F.bin(n))).cast("int")


def _entered(side: DataFrame, first: str, last: str, levels: Column) -> DataFrame:
    """A row for each of ``levels`` and each cell there that the range touches."""
    each = side.withColumn("_at", F.explode(levels))
    return each.withColumn("_cell", F.explode(F.sequence(_cell(F.col(first)), _cell(F.col(last)))))


def _cell(number: Column) -> Column:
    return F.call_function("shiftright", number.cast("long"), F.col("_at"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose ranges (both ends included) share a number, with all columns of both.

    Apart from ``keys`` the two sides have no column name in common. Rows with a null key or end, and ranges that end before they
    begin, meet nothing; repeated rows are pairs of their own; an empty side gives an empty table.
    """
    (a, b), (c, d) = left_range, right_range
    whole = lambda df, x, y: df.where(F.col(x) <= F.col(y)).withColumn("_level", _level(F.col(x).cast("long"), F.col(y).cast("long")))
    left, right = whole(left, a, b), whole(right, c, d)
    there = [sorted(r[0] for r in df.select("_level").distinct().collect()) for df in (left, right)]  # 64 numbers at most
    own = F.array(F.col("_level"))
    above = lambda of, least: F.filter(F.array(*map(F.lit, of)).cast("array<int>"), lambda x: x >= F.col("_level") + least)
    out = None
    # The right side's level is the larger or equal one; then the left side's is.
    for x, y in ((_entered(left, a, b, above(there[1], 0)), _entered(right, c, d, own)), (_entered(left, a, b, own), _entered(right, c, d, above(there[0], 1)))):
        x, y = x.drop("_level"), y.drop("_level")
        met = x.join(y, [*keys, "_at", "_cell"]).where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)))
        met = met.where(_cell(F.greatest(F.col(a).cast("long"), F.col(c).cast("long"))) == F.col("_cell")).drop("_at", "_cell")
        out = met if out is None else out.unionByName(met)
    return out
