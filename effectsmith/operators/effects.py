"""Elementary effects of a trajectory design and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def elementary_effects(design: DataFrame, outcome: DataFrame) -> DataFrame:
    """(traj, step, var_idx, ee): change of the outcome over the change in the unit cube, by step.

    ``design`` as from ``morris_design``; ``outcome``: (traj, step, y). Steps without outcome on either
    side have no effect. Windows run over one trajectory, a bounded number of rows.
    """
    changed = design.filter("step = flip").select("traj", "step", "var_idx", F.col("u").alias("after"))
    before = design.filter("step = flip - 1").select("traj", "var_idx", F.col("u").alias("before"))
    w = Window.partitionBy("traj").orderBy("step")
    near = outcome.withColumns({"y0": F.lag("y").over(w), "s0": F.lag("step").over(w)}).filter("s0 = step - 1")
    rows = changed.join(before, ["traj", "var_idx"]).join(near, ["traj", "step"])
    return rows.select("traj", "step", "var_idx", ((F.col("y") - F.col("y0")) / (F.col("after") - F.col("before"))).alias("ee"))


def effect_statistics(effects: DataFrame) -> DataFrame:
    """(var_idx, n, mu, mu_star, sigma) of each variable."""
    return effects.groupBy("var_idx").agg(
        F.count("*").alias("n"), F.avg("ee").alias("mu"), F.avg(F.abs("ee")).alias("mu_star"), F.stddev_samp("ee").alias("sigma")
    )
