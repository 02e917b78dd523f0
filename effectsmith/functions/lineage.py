"""Cutting lineage with a table in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset and Spark runs in one process (tests), a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = getattr(spark, "_effectsmith_dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._effectsmith_dir = folder
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "step", group_rows: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Every executor can read the files, so a lost executor costs a task retry only, and the next plan
    sees true sizes (adaptive execution picks its joins by them). Rows with long arrays need ``group_rows``: the
    reader unfolds up to 4096 rows of a row group at once, and the writer holds a group of encoded rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"parquet.block.row.count.limit": group_rows} if group_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
