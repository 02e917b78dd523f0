import numpy as np
import pytest
from pyspark.sql import functions as F

from effectsmith.functions import expressions as ex
from effectsmith.operators import hits, series

HITS = "sample_id long, x_m double, y_m double, z_m double, t_ns double, energy_ev double"
NAN = float("nan")


def manifest(spark, pt=75.0, rows=((1, "A"),), qx=(-1.0, 1.0), qy=(0.0, 0.0)):
    base = spark.createDataFrame([(i, n, list(qx), list(qy)) for i, n in rows], "sample_id long, sample_name string, qx array<double>, qy array<double>")
    values = {"gap": 191e-6, "chip_z": 2.625e-4, "pt": pt, "f_01": 4.3e9, "r": 25e-6, "s": 0.05, "i_ph": 1.673 * 8.916e5, "n_cooper": 4e6, "height": 10.0, "width": 10.0, "thickness": 0.12, "n_sim": 1e4}
    return base.withColumns({k: F.lit(v) for k, v in values.items()})


ROWS = [
    (1, 0.0009, 0.0, 2.625e-4, 149.0, 382e-6),
    (1, 0.0, 0.0, 2.625e-4, 150.0, 573e-6),
    (1, -0.002, 0.0, 2.625e-4, 450.0, 286.5e-6),
    (1, 0.001, 0.0, 2.625e-4, 330000.0, 95.5e-6),
    (1, 0.001, 0.0, 2.6250012e-4, 0.0, 0.0),
    (1, 0.001, 0.0, 2.625e-4 + 1.2e-8, 151.0, 191e-6),
    (1, 0.001, 0.0, 2.625e-4 + 1.3e-8, 151.0, 191e-6),
    (1, 0.001, 0.0, -2.625e-4, 151.0, 191e-6),
]


def test_hits_are_assigned_to_nearest_site_and_bin(spark):
    qp = hits.histogram(spark.createDataFrame(ROWS, HITS), manifest(spark))
    got = {(r["electrode"], r["bin"]): r["qps"] for r in qp.collect()}
    assert got == {(1, 0): 2, (0, 0): 3, (0, 1): 2, (1, 1000): 0, (1, 1): 1}
    totals = {r["electrode"]: r["qps"] for r in hits.electrode_totals(qp).collect()}
    assert totals == {0: 5, 1: 3}
    counts = hits.hit_counts(spark.createDataFrame(ROWS, HITS), manifest(spark)).first()
    assert (counts["hit_rows"], counts["surface_hits"]) == (8, 5)


def test_nan_and_null_hits_are_rejected(spark):
    bad = [(1, 0.0, 0.0, 2.625e-4, NAN, 1e-3), (1, NAN, 0.0, 2.625e-4, 1.0, 1e-3), (1, 0.0, 0.0, 2.625e-4, 1.0, NAN), (1, None, 0.0, 2.625e-4, 1.0, 1e-3)]
    frame = spark.createDataFrame(bad, HITS)
    joined = hits.with_manifest(frame, manifest(spark))
    assert hits.surface_hits(joined).filter("x_m is not null").count() == 0
    assert hits.rejected_hits(joined).count() == 4


def test_nearest_bin_against_brute_force(spark):
    rng = np.random.default_rng(1)
    t = np.concatenate([rng.uniform(-1000, 400000, 500), np.arange(0, 3000, 150.0), [150.0, np.nextafter(150.0, 0), np.nextafter(150.0, 200)]])
    grid = np.linspace(0, 300000.0, 1001)
    expected = [int(np.argmin(np.abs(x - grid))) for x in t]
    frame = spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "i int, t double")
    got = [r["b"] for r in frame.select("i", ex.nearest_bin(F.col("t")).alias("b")).orderBy("i").collect()]
    assert got == expected


@pytest.mark.parametrize(("pt", "n_p", "peak", "area"), [(75.0, 250, 9.674416283, 1018.68244), (125.0, 417, 9.890367384, 1760.875137), (150.0, 500, 9.90381501, 2131.268621)])
def test_recurrence_has_the_known_values(spark, pt, n_p, peak, area):
    qp = spark.createDataFrame([(1, 0, 1, 3.0), (1, 0, 10, 1.0), (1, 1, 1000, 2.0)], "sample_id long, electrode int, bin int, qps double")
    m = manifest(spark, pt)
    for rows in (series.summaries(qp, m), series.summaries_by_fold(qp, m)):
        got = rows.agg(F.max("peak").alias("p"), F.sum("area").alias("a")).first()
        assert got["p"] == pytest.approx(peak, rel=1e-8)
        assert got["a"] == pytest.approx(area, rel=1e-8)
    whole = series.full_series(qp, m).orderBy("electrode").collect()
    assert len(whole[0]["t"]) == 1001 + n_p
    assert max(max(r["dg"]) for r in whole) == pytest.approx(peak, rel=1e-8)
    total = sum(np.trapezoid(r["dg"], r["t"]) for r in whole)
    assert total == pytest.approx(area, rel=1e-8)


def test_missing_and_empty_samples(spark):
    three = manifest(spark, rows=((1, "A"), (2, "B"), (3, "C")))
    listing = spark.createDataFrame([("A",), ("B",)], "sample_name string")
    there = hits.available(three, listing)
    frame = spark.createDataFrame(ROWS, HITS)
    rows = series.study_summary(hits.hit_counts(frame, there), hits.histogram(frame, there), there).orderBy("sample_id").collect()
    assert [r["sample_name"] for r in rows] == ["A", "B"]
    assert rows[0]["electrode_qps"] == [5.0, 3.0]
    assert rows[1]["electrode_qps"] == [0.0, 0.0] and rows[1]["total_qps"] == 0 and rows[1]["peak_dg_mhz"] == 0
    assert [r["sample_name"] for r in hits.skipped(three, listing).collect()] == ["C"]


def test_dense_grid_and_empty_input(spark):
    frame = spark.createDataFrame(ROWS, HITS)
    grid = hits.dense(hits.histogram(frame, manifest(spark)), manifest(spark)).collect()
    assert {len(r["qps"]) for r in grid} == {1001} and sum(sum(r["qps"]) for r in grid) == 8
    none = hits.histogram(spark.createDataFrame([], HITS), manifest(spark))
    assert none.count() == 0
    assert series.summaries(none, manifest(spark)).count() == 0


def test_convolution_is_a_trailing_sum(spark):
    qp = spark.createDataFrame([(1, 0, 1, 3.0), (1, 0, 10, 1.0)], "sample_id long, electrode int, bin int, qps double")
    rows = series.convolved(qp, manifest(spark)).orderBy("step").collect()
    scale = 1.673 * 8.916e5 / (4e6 * 10 * 10 * 0.12 * 1e4)
    assert [(r["step"], round(r["g"] / scale)) for r in rows] == [(1, 3), (10, 4), (251, 1), (260, 0)]


def test_float_text_and_durations(spark):
    values = [9.6e-05, 0.000191, 1e-05, 0.12, 10.0, 4.3e9, 7.41e-56, 123456.789, 0.0, -0.5, 2.43, 1e16, 1.5e22]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r["t"] for r in frame.select("i", ex.float_text(F.col("v")).alias("t")).orderBy("i").collect()] == [repr(v) for v in values]
    d = spark.createDataFrame([(-5.0,), (59.9,), (61.0,), (3723.0,)], "s double")
    assert [r["t"] for r in d.select(ex.duration_text(F.col("s")).alias("t")).collect()] == ["0s", "59s", "1m 01s", "1h 02m 03s"]


def test_hash_sampling(spark):
    frame = spark.createDataFrame([("Morris_0",), ("Morris_1",), ("Morris_2",)], "n string")
    got = [r["f"] for r in frame.select(ex.hash_fraction(F.lit("morris"), F.col("n")).alias("f")).collect()]
    assert got == pytest.approx([0.035415947027929585, 0.49934034394131915, 0.7866482523506825], rel=1e-15)
    keep = lambda mode: [r["k"] for r in frame.select(ex.keeps_log(F.lit(mode), F.lit(0.04), F.lit("morris"), F.col("n")).alias("k")).collect()]
    assert keep("random") == [True, False, False] and keep("full") == [True] * 3 and keep("none") == keep("failures") == [False] * 3
