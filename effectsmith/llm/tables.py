"""Reading the corpus tables; words and hashes as the operators define them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectsmith.functions.shipping import shipped

WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int, number: int) -> Column:
    """True for rows whose crc32 of the id, as text, has this remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == number, F.lit(False))


def texts_kept(docs: DataFrame, judge: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """Whole rows of ``docs`` whose text ``judge`` keeps; it sees the texts of up to 1000 rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                yield batch.filter(pa.array(judge(batch.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
