"""The study's tables, derived from the driver's tables, in Spark and as SQL with the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Electrode places in mm.
QX = [-2, 0, 2, -2, 0, 2, -2, 0, 2, 1, -1, 1, -1, -3, 1, -1, 3]
QY = [-2, -2, -2, 0, 0, 0, 2, 2, 2, -3, -1, 1, 3, -1, -1, 1, 1]
# Levels of the gap (eV) and of the pulse (us), by sample number mod 4.
GAPS = [9.6e-05, 0.000159, 0.000223, 0.000286]
PULSES = [75.0, 125.0, 175.0, 225.0]
ODE_VALUES = {"chip_z": 2.625e-4, "f_01": 4.3e9, "r": 25e-6, "s": 0.05, "i_ph": 1.673 * 8.916e5, "n_cooper": 4e6, "height": 10.0, "width": 10.0, "thickness": 0.12, "n_sim": 1e4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.col("l_suppkey").alias("sample_id"),
        ((F.col("l_partkey") * 37 % 801 - 400) / 100000.0).alias("x_m"),
        ((F.col("l_partkey") * 53 + F.col("l_linenumber") * 101).cast("long") % 801 / 100000.0 - 0.004).alias("y_m"),
        F.when(F.col("l_returnflag") == "R", 2.625e-4).otherwise(-2.625e-4).alias("z_m"),
        ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 330000).cast("double").alias("t_ns"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity") * 1e-5).alias("energy_ev"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample a supplier."""
    k = (F.col("s_suppkey") % 4).cast("int")
    pick = lambda values: F.array(*[F.lit(float(v)) for v in values])[k]
    fixed = [F.lit(v).alias(c) for c, v in ODE_VALUES.items()]
    sites = [F.array(*[F.lit(float(v)) for v in q]).alias(c) for c, q in (("qx", QX), ("qy", QY))]
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sample_id"), F.concat(F.lit("Morris_"), F.col("s_suppkey").cast("string")).alias("sample_name"),
        pick(GAPS).alias("gap"), pick(PULSES).alias("pt"), *fixed, *sites,
    )


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with one variable a nation."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.cast("int").alias("var_idx"), F.col("n_name").alias("name"),
        (191e-6 * (k + 1) * 0.5).alias("lo"), (191e-6 * (k + 1) * 1.5).alias("hi"), (191e-6 * (k + 1)).alias("default"),
        F.when(F.col("n_regionkey") == 0, "ode").when(F.col("n_regionkey") == 1, "config").otherwise("macro").alias("target"),
    )


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("traj"))


def outcome(spark: SparkSession, sf_dir: str, steps: int) -> DataFrame:
    """A response for each trajectory and step."""
    item = table(spark, sf_dir, "lineitem")
    return item.groupBy(F.col("l_suppkey").alias("traj"), (F.col("l_orderkey") % steps).cast("int").alias("step")).agg(F.avg("l_quantity").alias("y"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from effectsmith.sources.readers import split_lines

    return split_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run an event: class by type, wall time and memory by value."""
    rc = F.when(F.col("event_type") == "error", 139).when(F.col("event_type") == "signup", 1).otherwise(0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("user_id"), rc.alias("rc"), (F.col("value") > 400).alias("timed_out"),
        F.col("value").alias("wall_s"), (60 + F.col("value") * F.col("value") / 100).alias("peak_rss_mb"),
        F.col("ts").alias("finished_at"), F.col("props").alias("message"), F.col("event_type").alias("status"),
    )


def _list(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


HITS_SQL = """hits AS (SELECT l_suppkey AS sample_id, (l_partkey * 37 % 801 - 400) / 100000.0::DOUBLE AS x_m,
 CAST((l_partkey * 53 + l_linenumber * 101) % 801 AS BIGINT) / 100000.0::DOUBLE - 0.004::DOUBLE AS y_m,
 CASE WHEN l_returnflag = 'R' THEN 2.625e-4::DOUBLE ELSE -2.625e-4::DOUBLE END AS z_m,
 CAST((l_orderkey * 7919 + l_linenumber * 104729) % 330000 AS DOUBLE) AS t_ns,
 CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_quantity * 1e-5::DOUBLE END AS energy_ev FROM lineitem)"""
MANIFEST_SQL = f"""manifest AS (SELECT s_suppkey AS sample_id, 'Morris_' || s_suppkey AS sample_name,
 ({_list(GAPS)})[s_suppkey % 4 + 1] AS gap, ({_list(PULSES)})[s_suppkey % 4 + 1] AS pt, {_list(QX)} AS qx, {_list(QY)} AS qy,
 {", ".join(f"{v!r}::DOUBLE AS {c}" for c, v in ODE_VALUES.items())} FROM supplier)"""
SURFACE_SQL = """surface AS (SELECT h.*, m.gap, m.qx, m.qy FROM hits h JOIN manifest m USING (sample_id)
 WHERE energy_ev > 0 AND abs(z_m - chip_z) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(chip_z))"""
QP_SQL = """dist AS (SELECT *, list_transform(range(len(qx)), lambda i: sqrt((x_m * 1000.0::DOUBLE - qx[i + 1]) * (x_m * 1000.0::DOUBLE - qx[i + 1])
  + (y_m * 1000.0::DOUBLE - qy[i + 1]) * (y_m * 1000.0::DOUBLE - qy[i + 1]))) AS d FROM surface),
 qp AS (SELECT sample_id, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS electrode,
  CAST(least(greatest(ceil(t_ns / 300.0::DOUBLE - 0.5::DOUBLE), 0), 1000) AS INTEGER) AS bin, sum(round_even(energy_ev / gap, 0)) AS qps FROM dist GROUP BY ALL)"""
QP_WITH = f"WITH {HITS_SQL}, {MANIFEST_SQL}, {SURFACE_SQL}, {QP_SQL}"
PARAMS_SQL = """params AS (SELECT n_nationkey AS var_idx, n_name AS name, 191e-6::DOUBLE * (n_nationkey + 1) * 0.5::DOUBLE AS lo,
 191e-6::DOUBLE * (n_nationkey + 1) * 1.5::DOUBLE AS hi, 191e-6::DOUBLE * (n_nationkey + 1) AS "default",
 CASE WHEN n_regionkey = 0 THEN 'ode' WHEN n_regionkey = 1 THEN 'config' ELSE 'macro' END AS target FROM nation)"""
HASH_SQL = "('0x' || substr(md5({}), 1, 8))::BIGINT"
DESIGN_SQL = f"""{PARAMS_SQL}, each AS MATERIALIZED (SELECT s_suppkey AS traj, var_idx, lo, hi,
  {HASH_SQL.format("'morris:order:' || s_suppkey || ':' || var_idx")} AS o, {HASH_SQL.format("'morris:level:' || s_suppkey || ':' || var_idx")} AS b FROM supplier, params),
 flips AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY traj ORDER BY o, var_idx) AS INTEGER) AS flip, (b // 2) % 2 = 0 AS up FROM each),
 leveled AS (SELECT traj, CAST(step AS INTEGER) AS step, var_idx, flip, lo, hi,
  CAST(CASE WHEN step < flip THEN CASE WHEN up THEN b % 2 ELSE 2 + b % 2 END ELSE CASE WHEN up THEN 2 + b % 2 ELSE b % 2 END END AS INTEGER) AS level
  FROM flips, (SELECT unnest(range(0, (SELECT count(*) + 1 FROM nation))) AS step)),
 design AS (SELECT traj, step, var_idx, flip, level, level / 3.0::DOUBLE AS u,
  round_even((level / 3.0::DOUBLE * (hi - lo) + lo) * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS value, traj * (SELECT count(*) + 1 FROM nation) + step AS sample_id FROM leveled)"""
LINES_SQL = """lines AS (SELECT doc_id AS doc, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"""
RUNS_SQL = """runs AS (SELECT event_id AS run_id, user_id, CASE WHEN event_type = 'error' THEN 139 WHEN event_type = 'signup' THEN 1 ELSE 0 END AS rc, value > 400 AS timed_out,
 value AS wall_s, 60 + value * value / 100 AS peak_rss_mb, ts AS finished_at, props AS message, event_type AS status FROM events)"""
CLASS_SQL = "CASE WHEN timed_out THEN 'timeout' WHEN rc = 0 THEN 'ok' WHEN rc = 139 THEN 'teardown' ELSE 'failed' END"
