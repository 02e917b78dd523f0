"""Hits that keep arriving: a file stream, joined with the manifest and counted batch by batch.

Each micro-batch adds its counts under its own batch folder, written in overwrite mode, so a batch that
is run again after a failure replaces itself; the sum over batches equals the batch result. Late times
land in the edge bins and nothing is dropped, so there is no watermark.

Totals by sample and electrode are also kept as keyed state: the stream of CSV files is joined with the manifest
and summed in the state store, and each micro-batch writes the keys that it changed with their new totals. State
grows with samples times sites, not with hits. A stream that is started again goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effectsmith.operators.hits import assigned, histogram, surface_hits
from effectsmith.sources.readers import HITS_CSV, hits_schema

HITS_SCHEMA = "sample_id long, x_m double, y_m double, z_m double, t_ns double, energy_ev double"


def start(spark: SparkSession, hits_path: str, manifest: DataFrame, out: str, checkpoint: str, files_per_batch: int = 4):
    """Starts the query over all files there; returns it."""
    hits = spark.readStream.schema(HITS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(hits_path)

    def add(batch: DataFrame, batch_id: int) -> None:
        histogram(batch, manifest).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return hits.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, out: str) -> DataFrame:
    """Counts so far: (sample_id, electrode, bin, qps)."""
    rows = spark.read.parquet(out)
    return rows.groupBy("sample_id", "electrode", "bin").agg(F.sum("qps").alias("qps"))


def start_totals(
    spark: SparkSession, hits_path: str, manifest: DataFrame, out: str, checkpoint: str, files_per_batch: int = 200, header: list[str] | None = None, pattern: str | None = r"([^/]+?)_hitsfile"
):
    """Starts the query over the hits CSV files there; returns it. The sample's name is in a file's path, or,
    without ``pattern``, in the column sample_name of files of many samples; ``header`` names the files' columns where
    they have others beside the five. Files without manifest entry wait for nobody:
    their hits are in no total."""
    source = spark.readStream.schema(hits_schema(header)).option("header", True).option("enforceSchema", False)
    files = source.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).csv(hits_path)
    name = F.regexp_extract("_metadata.file_path", pattern, 1).alias("sample_name") if pattern else F.col("sample_name")
    hits = files.select(name, *[F.col(f"`{a}`").alias(b) for a, b in HITS_CSV.items()])
    joined = hits.join(manifest.select("sample_name", "sample_id", "gap", "chip_z", "qx", "qy"), "sample_name")
    totals = assigned(surface_hits(joined)).groupBy("sample_id", "electrode").agg(F.sum("qps").alias("qps"), F.count("*").alias("hits"))

    def put(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return totals.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """Totals so far: the latest (sample_id, electrode, qps, hits) of every key."""
    rows = spark.read.parquet(out)
    latest = rows.groupBy("sample_id", "electrode").agg(F.max_by(F.struct("qps", "hits"), "batch").alias("l"))
    return latest.select("sample_id", "electrode", "l.qps", "l.hits")
