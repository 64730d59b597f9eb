"""Joins of half-open intervals [start, end) by equality of bins, and running sums over their edges.

Bins of level l have 2**(SHIFT + 3 l) bases, eight of the level below. An interval belongs to the smallest bin that holds all of it; a
position lies in one bin of each level, so it looks up LEVELS bins, whatever the lengths of intervals, and no interval is
expanded. Two intervals overlap only if the smaller one's bin, taken up to the level of the other one, is the other one's bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHIFT = 14
LEVELS = 9  # the last one has bins of 2**38 bases
TOP = SHIFT + 3 * (LEVELS - 1)


def _bin(pos: Column | str, level: Column | int) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    shift = level * 3 + SHIFT
    return F.call_function("shiftright", pos.cast("long"), shift.cast("int") if isinstance(shift, Column) else F.lit(shift))


def with_bin(intervals: DataFrame) -> DataFrame:
    """Intervals with __level and __bin, the smallest bin that holds them; empty intervals are left out."""
    intervals = intervals.filter("start < end")
    level = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(_bin("start", k) == _bin(F.col("end") - 1, k), F.lit(k)).otherwise(level)
    return intervals.withColumn("__level", level.cast("int")).withColumn("__bin", _bin("start", F.col("__level")))


def points_in(points: DataFrame, intervals: DataFrame, by: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """A row for each point and interval that holds it, with the columns of both; by (contig) joins them, no other name may be in both."""
    by = by or ["contig"]
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("l"), _bin(pos, k).alias("b")) for k in range(LEVELS)))).alias("__k")
    looked = points.select("*", keys).select(*points.columns, F.col("__k.l").alias("__level"), F.col("__k.b").alias("__bin"))
    return looked.join(with_bin(intervals), [*by, "__level", "__bin"]).filter((F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("end"))).drop("__level", "__bin")


def overlapping(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each pair of intervals that share a base: by, the columns of left, and those of right with the prefix ``other_``."""
    by = by or ["contig"]
    rest = [c for c in right.columns if c not in by]
    other = [F.col(c).alias(f"other_{c}") for c in rest]
    a = with_bin(left)
    b = with_bin(right).select(*by, *other, F.col("__level").alias("__other_level"), F.col("__bin").alias("__other_bin"))
    names = [*by, *(c for c in left.columns if c not in by), *(f"other_{c}" for c in rest)]

    def up(df: DataFrame, start: str, level: str, own: bool) -> DataFrame:
        """Rows with the bin of each level from their own one (or the next) up."""
        first = F.col(level) + (0 if own else 1)
        levels = F.when(first < LEVELS, F.sequence(first, F.lit(LEVELS - 1))).otherwise(F.array().cast("array<int>"))
        return df.withColumn("__up", F.explode(levels)).withColumn("__at", _bin(start, F.col("__up")))

    one = up(a, "start", "__level", True).join(b.withColumnRenamed("__other_level", "__up").withColumnRenamed("__other_bin", "__at"), [*by, "__up", "__at"])
    two = up(b, "other_start", "__other_level", False).join(a.withColumnRenamed("__level", "__up").withColumnRenamed("__bin", "__at"), [*by, "__up", "__at"])
    both = one.select(*names).unionByName(two.select(*names))
    return both.filter((F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end")))


def running_sums(edges: DataFrame, by: list[str], at: str, columns: list[str], block: int) -> DataFrame:
    """(by, at, __end, columns): sums of columns from the first edge on, which hold from at up to __end, the next edge (null after the last).

    edges has a row for each (by, at). Sums run within blocks of ``block`` values of at and start with the sums of the blocks before, so no key is one task.
    """
    edges = edges.withColumn("__b", F.floor(F.col(at) / block))
    totals = edges.groupBy(*by, "__b").agg(F.min(at).alias("__first"), *(F.sum(c).alias(f"__{c}") for c in columns))
    order = Window.partitionBy(*by).orderBy("__b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__b", F.lead("__first").over(order).alias("__next"), *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns))
    inside = Window.partitionBy(*by, "__b").orderBy(at)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = edges.join(totals, [*by, "__b"])
    return rows.select(*by, at, F.coalesce(F.lead(at).over(inside), "__next").alias("__end"), *((F.col(f"__{c}") + F.sum(c).over(upto)).alias(c) for c in columns))
