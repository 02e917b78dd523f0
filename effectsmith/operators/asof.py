"""Nearest and as-of join of points with a grid of any spacing.

Distinct places of points and grid are sorted together and dealt to ranges; in each range every place carries the
last grid point before it and the next one behind it. What reaches over the edge of a range comes from one row a
range. So neither a long grid nor a place that a third of all points share is one task's: points join their
place's answer by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written


def carried(points: DataFrame, grid: DataFrame, at: str, keys: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """(keys, ``at``, before, behind) for each distinct place of ``points``: the grid's rows at or before it and at or
    behind it, as structs of ``at`` and the grid's other columns, null where there is none.

    Keys are compared as joins do: null keys match nothing. Places that are null or NaN have no neighbour. Of equal
    grid places the row with the least other columns stands for all.
    """
    keys = keys or []
    usable = lambda df: df.filter(F.col(at).isNotNull() & ~_is_nan(df, at))
    rest = [c for c in grid.columns if c not in (*keys, at)]
    held = usable(grid).groupBy(*keys, at).agg(F.min(F.struct(*rest)).alias("g") if rest else F.first(F.struct(F.lit(True).alias("is_grid"))).alias("g"))
    row = F.struct(F.col(at), *[F.col(f"g.{c}").alias(c) for c in rest])
    grid_rows = held.select(*keys, at, row.alias("g"))
    places = usable(points).select(*keys, at).distinct()
    both = grid_rows.unionByName(places, allowMissingColumns=True)
    dealt = both.repartitionByRange(ranges, *keys, at) if ranges else both.repartitionByRange(*keys, at)
    # equal places are in one range; the number of the range is fixed by writing it down
    dealt = written(dealt.withColumn("range", F.spark_partition_id()).withColumn("is_place", F.col("g").isNull()), "ranges")
    up = Window.partitionBy("range", *keys).orderBy(F.col(at), F.col("is_place")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("range", *keys).orderBy(F.col(at).desc(), F.col("is_place")).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("before", F.last("g", ignorenulls=True).over(up)).withColumn("behind", F.last("g", ignorenulls=True).over(down)).filter("is_place")
    edges = dealt.groupBy("range", *keys).agg(F.max("g").alias("most"), F.min("g").alias("least"))  # a row a range and key in it
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reach = edges.select("range", *keys, F.last("most", ignorenulls=True).over(earlier).alias("from_before"), F.last("least", ignorenulls=True).over(later).alias("from_behind"))
    return inside.join(reach, ["range", *keys]).select(*keys, at, F.coalesce("before", "from_before").alias("before"), F.coalesce("behind", "from_behind").alias("behind"))


def _is_nan(df: DataFrame, c: str) -> Column:
    return F.isnan(c) if df.schema[c].dataType.simpleString() in ("double", "float") else F.lit(False)


def nearest(points: DataFrame, grid: DataFrame, at: str, keys: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """``points`` with the struct ``nearest`` of the grid's nearest row; of two as near the lower one. Places beyond the
    grid get its edge; no grid, null or NaN: null. ``at`` is a number."""
    low, high = F.col("before"), F.col("behind")
    take_low = high.isNull() | (low.isNotNull() & (F.col(at) - low[at] <= high[at] - F.col(at)))
    answers = carried(points, grid, at, keys, ranges).select(*(keys or []), at, F.when(take_low, low).otherwise(high).alias("nearest"))
    return points.join(answers, [*(keys or []), at], "left")


def as_of(points: DataFrame, grid: DataFrame, at: str, keys: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """``points`` with the struct ``before`` of the grid's last row at or before their place (a number or a time)."""
    answers = carried(points, grid, at, keys, ranges).select(*(keys or []), at, "before")
    return points.join(answers, [*(keys or []), at], "left")
