"""Hits to quasiparticle counts: filters, nearest site and bin, histograms and totals.

manifest (sample_id, gap, chip_z, qx array, qy array, ...); hits (sample_id, x_m, y_m, z_m, t_ns,
energy_ev). Sites stand as arrays in the manifest row, so assignment is an expression and not a join of
hits with sites. The manifest joins by sample without a hint: it is broadcast only when adaptive
execution finds it small; a sample with a third of all hits is then no matter, and otherwise its side of
the join is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectsmith.functions.expressions import BINS, is_close, nearest_bin, nearest_site


def with_manifest(hits: DataFrame, manifest: DataFrame) -> DataFrame:
    """Hits of the samples in the manifest, with gap, chip_z and sites."""
    return hits.join(manifest.select("sample_id", "gap", "chip_z", "qx", "qy"), "sample_id")


def surface_hits(joined: DataFrame) -> DataFrame:
    """Hits with energy on the sensor surface; NaN energies, times and places are not hits."""
    finite = ~(F.isnan("energy_ev") | F.isnan("t_ns") | F.isnan("x_m") | F.isnan("y_m"))
    return joined.filter((F.col("energy_ev") > 0) & finite & is_close(F.col("z_m"), F.col("chip_z")))


def rejected_hits(joined: DataFrame) -> DataFrame:
    """Hits whose numbers are missing or NaN: they belong to no electrode or bin."""
    bad = [F.isnull(c) | F.isnan(c) for c in ("energy_ev", "t_ns", "x_m", "y_m", "z_m")]
    return joined.filter(bad[0] | bad[1] | bad[2] | bad[3] | bad[4])


def assigned(surface: DataFrame) -> DataFrame:
    """(sample_id, electrode, bin, qps) of every surface hit; counts are rounded hit by hit."""
    site = nearest_site(F.col("x_m") * 1000.0, F.col("y_m") * 1000.0, F.col("qx"), F.col("qy"))
    return surface.select("sample_id", site.alias("electrode"), nearest_bin(F.col("t_ns")).alias("bin"), F.rint(F.col("energy_ev") / F.col("gap")).alias("qps"))


def histogram(hits: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sparse counts (sample_id, electrode, bin, qps): one shuffle after partial sums."""
    rows = assigned(surface_hits(with_manifest(hits, manifest)))
    return rows.groupBy("sample_id", "electrode", "bin").agg(F.sum("qps").alias("qps"))


def electrode_totals(qp: DataFrame) -> DataFrame:
    return qp.groupBy("sample_id", "electrode").agg(F.sum("qps").alias("qps"), F.max("qps").alias("max_bin_qps"))


def greatest_total(qp: DataFrame) -> DataFrame:
    """(sample_id, most_qps): the greatest electrode total of each sample."""
    return electrode_totals(qp).groupBy("sample_id").agg(F.max("qps").alias("most_qps"))


def totals_rollup(qp: DataFrame) -> DataFrame:
    """Counts by sample and electrode, by sample, and over all (nulls mark the levels)."""
    return qp.rollup("sample_id", "electrode").agg(F.sum("qps").alias("qps"))


def dense(qp: DataFrame, manifest: DataFrame) -> DataFrame:
    """(sample_id, electrode, held_bins, qps array of all bins, their total) for every site of every sample, zeros filled in.

    Arrays are built where the sparse counts already are, a bounded number of bins a key: numpy puts the held bins of
    some hundred keys into zeros at once.
    """
    filled = qp.groupBy("sample_id", "electrode").agg(F.collect_list(F.struct("bin", "qps")).alias("held"))
    sites = manifest.select("sample_id", F.explode(F.sequence(F.lit(0), F.size("qx") - 1)).alias("electrode"))
    joined = sites.join(filled, ["sample_id", "electrode"], "left").select("sample_id", "electrode", F.col("held.bin").alias("bin"), F.col("held.qps").alias("count"))
    return joined.mapInArrow(_filled, f"sample_id {joined.schema['sample_id'].dataType.simpleString()}, electrode int, held_bins long, qps array<double>, total double")


def zeros_filled(row: np.ndarray, count: pa.Array, size: int) -> pa.Array:
    """``size`` numbers, each count at its place and zero elsewhere; null counts stay null."""
    flat, known = np.zeros(size), count.is_valid().to_numpy(zero_copy_only=False)
    flat[row] = count.to_numpy(zero_copy_only=False)
    if known.all():
        return pa.array(flat)
    unknown = np.zeros(size, dtype=bool)
    unknown[row[~known]] = True
    return pa.array(flat, mask=unknown)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            held = pc.fill_null(pc.list_value_length(batch.column("bin")), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), held) * BINS + batch.column("bin").flatten().to_numpy(zero_copy_only=False)
            flat = zeros_filled(row, batch.column("count").flatten(), batch.num_rows * BINS)
            qps = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BINS), flat)
            total = pa.array(flat.to_numpy(zero_copy_only=False).reshape(-1, BINS).sum(axis=1), from_pandas=flat.null_count > 0)
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("electrode"), pa.array(held.astype(np.int64)), qps, total], ["sample_id", "electrode", "held_bins", "qps", "total"])


def hit_counts(hits: DataFrame, manifest: DataFrame) -> DataFrame:
    """All rows and surface rows of every sample that has a hits file (left join: zeros survive)."""
    from_hits = with_manifest(hits, manifest)
    surface = (F.col("energy_ev") > 0) & ~F.isnan("energy_ev") & is_close(F.col("z_m"), F.col("chip_z"))
    counts = from_hits.groupBy("sample_id").agg(F.count("*").alias("hit_rows"), F.count_if(surface).alias("surface_hits"))
    return manifest.select("sample_id", "sample_name").join(counts, "sample_id", "left").fillna(0, ["hit_rows", "surface_hits"])


def available(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows whose hits file is listed; an empty file stays, a missing one does not."""
    return manifest.join(listing.select("sample_name").distinct(), "sample_name", "left_semi")


def skipped(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    return manifest.join(listing.select("sample_name").distinct(), "sample_name", "left_anti")
