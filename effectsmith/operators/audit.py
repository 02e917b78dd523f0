"""Audits of designs, documents, logs and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectsmith.operators.render import command_values


def inert(energy: Column, threshold: Column) -> Column:
    """A sample whose particles start below the tracking threshold makes no hits."""
    return energy < threshold


def hang_risk(limit: Column, energy: Column, gap: Column) -> Column:
    """A pair-breaking particle in a film with limit 1 never ends."""
    return (limit == 1) & (energy >= 2 * gap)


def islands(samples: DataFrame, group: str, order: str, flag: str) -> DataFrame:
    """Runs of equal flags along the order in each group: (group, flag, first, last, n)."""
    w, wf = Window.partitionBy(group).orderBy(order), Window.partitionBy(group, flag).orderBy(order)
    marked = samples.select(group, order, flag, (F.row_number().over(w) - F.row_number().over(wf)).alias("island"))
    return marked.groupBy(group, flag, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("island")


def run_class(status: Column, rc: Column, timed_out: Column) -> Column:
    """ok, teardown (all hits written, crash at exit), timeout or failed."""
    return F.when(timed_out, "timeout").when(rc == 0, "ok").when(rc == 139, "teardown").otherwise("failed")


def run_statistics(runs: DataFrame) -> DataFrame:
    """Wall time and memory by class of run."""
    return runs.groupBy("class").agg(
        F.count("*").alias("n"), F.avg("wall_s").alias("mean_wall_s"), F.max("wall_s").alias("max_wall_s"), F.max("peak_rss_mb").alias("max_rss_mb")
    )


#: Size of the quantile sketches; their rank error is below RANK_ERROR with a probability of over 99 %.
SKETCH_K, RANK_ERROR = 4096, 0.01


def run_quantiles(runs: DataFrame, value: str, probabilities: list[float]) -> DataFrame:
    """(class, probability, quantile, n, crash_rate) of each class of run and of ``all``, from one quantile sketch a
    class; those of the classes are merged for all, so runs are read once. ``crash_rate`` is the share of teardown
    crashes in the runs that completed. Nulls are in no sketch."""
    held = runs.filter(F.col(value).isNotNull())
    by_class = held.groupBy("class").agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K)).alias("sketch"), F.count("*").alias("n"))
    whole = by_class.agg(
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"), F.sum("n").alias("n"),
        (F.sum(F.when(F.col("class") == "teardown", F.col("n")).otherwise(0)) / F.sum(F.when(F.col("class").isin("ok", "teardown"), F.col("n")))).alias("crash_rate"),
    )
    every = whole.select(F.lit("all").alias("class"), "sketch", "n", "crash_rate").unionByName(by_class.withColumn("crash_rate", F.lit(None).cast("double")))
    asked = [F.struct(F.lit(p).alias("probability"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("quantile")) for p in probabilities]
    return every.withColumn("q", F.explode(F.array(*asked))).select("class", "q.probability", "q.quantile", "n", "crash_rate")


def runaway(runs: DataFrame, limit_mb: float) -> DataFrame:
    return runs.filter(F.col("peak_rss_mb") > limit_mb)


def progress(runs: DataFrame, key: str) -> DataFrame:
    """Done, elapsed seconds, rate and seconds left after each completion in each group."""
    w = Window.partitionBy(key).orderBy("finished_at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    done = F.count("*").over(w)
    elapsed = F.unix_micros("finished_at") - F.min(F.unix_micros("finished_at")).over(whole)
    rows = runs.select(key, "run_id", "finished_at", done.alias("done"), F.count("*").over(whole).alias("total"), elapsed.alias("elapsed_us"))
    return rows.withColumn("left_s", F.when(F.col("elapsed_us") > 0, (F.col("total") - F.col("done")) * (F.col("elapsed_us") / 1e6) / F.col("done")))


def reported(rows: DataFrame, every: int) -> DataFrame:
    """The first five, each ``every``-th and the last progress row."""
    return rows.filter((F.col("done") <= 5) | (F.col("done") % every == 0) | (F.col("done") == F.col("total")))


def pattern_counts(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Lines with each pattern by document and over all (null document)."""
    found = [F.count_if(F.coalesce(F.col("text").rlike(p), F.lit(False))).alias(name) for name, p in patterns.items()]
    return lines.rollup("doc").agg(*found, F.count("*").alias("lines"))


def fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Content fingerprint by key, whatever the order of rows: row count, sum and xor of row hashes."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    row = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sum(row).alias("sum"), F.bit_xor(row).alias("xor"))


def compared_runs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Verdict for each key of two fingerprint tables: identical, differs, only_a or only_b."""
    left, right = a.select(key, F.struct("n", "sum", "xor").alias("a")), b.select(key, F.struct("n", "sum", "xor").alias("b"))
    verdict = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.col("a") == F.col("b"), "identical").otherwise("differs")
    return left.join(right, key, "full_outer").select(key, verdict.alias("verdict"))


def failures(runs: DataFrame, key: str) -> DataFrame:
    """Failed and all runs of each group, and the greatest message."""
    return runs.groupBy(key).agg(F.count_if("failed").alias("n_failed"), F.count("*").alias("n_runs"), F.max(F.when(F.col("failed"), F.col("message"))).alias("last_message"))


def failure_messages(runs: DataFrame, key: str) -> DataFrame:
    """Every failed run with its message."""
    return runs.filter("failed").select(key, "run_id", "message")


def document_facts(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc, fact, holds): whether the document's first line of a command has the expected value behind it.

    ``expected``: (doc, fact, command, expected). A document without the command does not hold.
    """
    found = command_values(lines, expected)
    return expected.join(found, ["doc", "command"], "left").select("doc", "fact", (F.col("value") == F.col("expected")).alias("holds"))


def capacity(statistics: DataFrame, samples: int, workers: int) -> DataFrame:
    """Hours for a number of samples at the mean wall time of each class."""
    return statistics.withColumn("hours", F.col("mean_wall_s") * samples / workers / 3600)
