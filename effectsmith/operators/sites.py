"""Nearest site when sites are a table too long for one row.

Points and sites are keyed by square cells. A point meets the sites of its cell and the eight around it; its best
site is proven when it is no farther than the edge of that block. Points without proof go on to cells of twice the
size, until the block holds all sites. The first cells are so small that few sites share one, so a dense cluster is
settled there and only points far from any site meet large cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written

#: Sites that a cell of the first size may hold, and how often the cells are halved for it.
SITES_IN_CELL, HALVINGS = 16, 24


def _cell(x: str, size: float) -> F.Column:
    return F.floor(F.col(x) / F.lit(size))


def first_size(sites: DataFrame, width: float) -> float:
    """Size of the first cells: halved from ``width`` until no cell holds more than SITES_IN_CELL sites, or a cell
    with the most sites is not split any more (``sites`` has distinct places)."""
    size, most = width, None
    for _ in range(HALVINGS):
        now = sites.groupBy(_cell("sx", size), _cell("sy", size)).count().agg(F.max("count")).first()[0]
        if now <= SITES_IN_CELL:
            break
        size, most = size / 2, now
    return size


def nearest_site(points: DataFrame, sites: DataFrame) -> DataFrame:
    """(point_id, site, distance) of the nearest site of every point, the lowest site on ties; null without sites and
    for points whose place is null or NaN. ``points``: (point_id, x, y); ``sites``: (site, sx, sy).

    Each round writes what it has found and what is left, so the plan stays short and lost executors cost a task.
    """
    good = lambda df, x, y: df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    places = written(good(sites, "sx", "sy").groupBy("sx", "sy").agg(F.min("site").alias("site")), "sites")
    box = places.agg(F.min("sx"), F.max("sx"), F.min("sy"), F.max("sy"), F.count("*")).first()
    if not box[4]:
        return points.select("point_id", F.lit(None).cast(sites.schema["site"].dataType).alias("site"), F.lit(None).cast("double").alias("distance"))
    width = max(box[1] - box[0], box[3] - box[2]) or 1.0
    size = first_size(places, width)
    left = written(good(points, "x", "y").select("x", "y").distinct(), "places")
    found, around = [], lambda cell: F.explode(F.array(*[cell + k for k in (-1, 0, 1)]))
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    while True:
        cx, cy = _cell("x", size), _cell("y", size)
        spread = places.select("site", "sx", "sy", around(_cell("sx", size)).alias("cx"))
        spread = spread.select("site", "sx", "sy", "cx", around(_cell("sy", size)).alias("cy"))
        met = left.withColumn("cx", cx).withColumn("cy", cy).join(spread, ["cx", "cy"], "left")
        best = met.groupBy("x", "y", "cx", "cy").agg(F.min(F.when(F.col("site").isNotNull(), F.struct(F.sqrt(dx * dx + dy * dy).alias("distance"), F.col("site").alias("site")))).alias("best"))
        # distance to the edge of the block; sites at the edge itself may be outside it
        to_edge = F.least(
            F.col("x") - (F.col("cx") - 1) * F.lit(size), (F.col("cx") + 2) * F.lit(size) - F.col("x"),
            F.col("y") - (F.col("cy") - 1) * F.lit(size), (F.col("cy") + 2) * F.lit(size) - F.col("y"),
        )
        holds_all = (
            ((F.col("cx") - 1) * F.lit(size) <= box[0]) & ((F.col("cx") + 2) * F.lit(size) > box[1])
            & ((F.col("cy") - 1) * F.lit(size) <= box[2]) & ((F.col("cy") + 2) * F.lit(size) > box[3])
        )
        # a little inside the edge: cells are found by division, whose rounding is far below a billionth
        proven = holds_all | (F.col("best.distance") < to_edge * (1 - 1e-9))
        done = written(best.select("x", "y", F.coalesce(proven, F.lit(False)).alias("proven"), "best.site", "best.distance"), "round")
        found.append(done.filter("proven").drop("proven"))
        left = done.filter("not proven").select("x", "y")
        if left.isEmpty():
            break
        size *= 2
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return points.join(every, ["x", "y"], "left").select("point_id", "site", "distance")
