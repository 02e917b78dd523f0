"""What must hold however large the tables are: which side is broadcast, what is shuffled, how many files there are."""

import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from effectsmith.functions import expressions, lineage, packing
from effectsmith.operators import design, hits, render, series, study
from effectsmith.plans import registry
from effectsmith.sources import catalog, readers, templates, writers


def planned(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_samples_commands_are_never_broadcast(spark, tmp_path):
    params = catalog.catalog(spark)
    values = design.morris_design(spark.range(2).select(F.col("id").alias("traj")), params).select("sample_id", "var_idx", "value")
    values.write.parquet(str(tmp_path / "design"))
    values = spark.read.parquet(str(tmp_path / "design"))  # so small a file that the planner would broadcast it
    swept = study.swept_commands(values, params)
    for frame in (swept, design.named_values(values, params, "ode")):
        sides = re.findall(r"BroadcastHashJoin .*?(Build\w+)", planned(frame))
        assert sides and set(sides) == {"BuildRight"}, planned(frame)
    swept.selectExpr("sample_id", "doc", "cast(ord as int) as line_no", "new_line as text", "ord as precedence").write.parquet(str(tmp_path / "overrides"))
    lines = render.rendered(templates.template(spark), spark.read.parquet(str(tmp_path / "overrides")))
    assert "SortMergeJoin" in planned(lines)  # the overridden lines of all samples


def test_series_records_are_not_shuffled(spark, tmp_path):
    manifest = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").select(
        F.col("s_suppkey").alias("sample_id"), *[F.lit(1.0).alias(c) for c in series.ODE if c != "pt"], F.lit(75.0).alias("pt")
    )
    qp = manifest.select("sample_id", F.lit(0).alias("electrode"), F.lit(3).alias("bin"), F.lit(2.0).alias("qps"))
    plan = series.dg_records(qp, manifest)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInPandas")]
    assert "Exchange" not in above and "Join" not in above, above


def files_under(path):
    return [f for f in path.rglob("*") if f.is_file() and f.suffix in (".parquet", ".csv", ".txt")]


FILE_QUERIES = ["src2_hits_and_rejects", "src2_src7_hits_csv", "src4_text_files", "src6_snk3_snk4_documents", "src7_file_listing", "snk4_nested_documents", "snk5_snk8_recomputed_samples", "str1_stateful_totals"]


@pytest.mark.parametrize("name", FILE_QUERIES)
def test_files_do_not_go_by_samples(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr(registry, "_fresh", lambda spark, n: str(tmp_path / n))
    sf = tmp_path / "sf"
    sf.mkdir()
    for t in ("supplier", "lineitem", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").coalesce(1).write.parquet(f"{sf}/{t}.parquet")
    registry.QUERIES[name](spark, str(sf)).collect()
    found = [f for f in files_under(tmp_path) if sf not in f.parents and "arriving-state" not in str(f)]
    assert 0 < len(found) <= 40, len(found)  # of 100 samples and 1,000 documents


def test_packed_files_are_read_as_loose_ones(spark, tmp_path):
    rows = [("a/b", "Si", 1, "x 1"), ("a/b", "Si", 2, ""), ("a/b", "Si", 3, "# é"), (None, "Ge", 1, "z"), ("none", "Si", 1, None)]
    writers.write_packed(spark.createDataFrame(rows, "name string, material string, line_no int, text string"), str(tmp_path / "p"), "name", "material")
    lines = {(r["doc"], r["line_no"]): r["text"] for r in readers.packed_lines(spark, str(tmp_path / "p"), r"name=([^/]+)/").collect()}
    assert lines == {("a%2Fb", 1): "x 1", ("a%2Fb", 2): "", ("a%2Fb", 3): "# é", ("__HIVE_DEFAULT_PARTITION__", 1): "z"}
    listed = {r["sample_name"]: r["length"] for r in readers.packed_listing(spark, str(tmp_path / "p"), r"name=([^/]+)/").collect()}
    assert listed == {"a%2Fb": 4 + 1 + 5, "__HIVE_DEFAULT_PARTITION__": 2, "none": 0}


def test_packed_hits_are_judged_as_loose_ones(spark, tmp_path):
    header = ",".join(readers.HITS_CSV)
    files = {"Fine": [header, "1,2,3,4,5\r", "1,,3,4,5"], "Bare": ["1,2,3,4,5"], "Only": [header], "Blank": [" "], "Cut": ['"Event",' + header, "9,1,2,3", "9,x,2,3,4,5"], "Zero": [None]}
    (tmp_path / "loose").mkdir()
    for name, own in files.items():
        (tmp_path / "loose" / f"{name}_hitsfile.txt").write_text("\n".join(t for t in own if t is not None))
    lines = [(f"{name}_hitsfile", n, t) for name, own in files.items() for n, t in enumerate(own, 1)]
    writers.write_packed(spark.createDataFrame(lines, "file string, line_no int, text string"), str(tmp_path / "packed"), "file")
    both = [readers.hits_csv_checked(spark, str(tmp_path / "loose")), readers.packed_hits_checked(spark, str(tmp_path / "packed"), r"file=([^/]+?)_hitsfile")]
    for loose, own in zip(*both, strict=True):
        assert sorted(map(str, loose.collect())) == sorted(map(str, own.collect()))


def test_last_run_of_every_sample_is_read(spark, tmp_path):
    path = str(tmp_path / "records")
    frame = lambda rows: spark.createDataFrame(rows, "sample_id long, v double")
    writers.write_run(frame([(k, float(k)) for k in range(4)]), path, 0)
    for _ in range(2):  # and again
        writers.write_run(frame([(1, 10.0), (1, 11.0)]), path, 1)
    got = readers.latest_records(spark, path)
    assert sorted((r["sample_id"], r["v"]) for r in got.collect()) == [(0, 0.0), (1, 10.0), (1, 11.0), (2, 2.0), (3, 3.0)]
    assert {r["sample_id"] for r in got.filter("run = 1").collect()} == {1}


def test_nearest_site_looks_at_every_site_once(spark):
    frame = spark.createDataFrame([(0.0, 0.0, [1.0, -1.0, None, 0.5], [0.0, 0.0, 0.0]), (0.0, 0.0, [], []), (None, 0.0, [1.0], [1.0])], "x double, y double, qx array<double>, qy array<double>")
    site = expressions.nearest_site(F.col("x"), F.col("y"), F.col("qx"), F.col("qy"))
    assert [r[0] for r in frame.select(site.alias("s")).collect()] == [0, None, None]  # the lower of a tie; a site without y is none
    assert site._jc.toString().lower().count("sqrt") == 1


def test_dense_grid_has_its_totals(spark):
    qp = spark.createDataFrame([(1, 1, 5, 2.0), (1, 1, 1000, 3.0), (1, 0, 0, None)], "sample_id long, electrode int, bin int, qps double")
    own = spark.createDataFrame([(1, [0.0, 1.0, 2.0])], "sample_id long, qx array<double>")
    rows = {r["electrode"]: r for r in hits.dense(qp, own).collect()}
    assert {k: (r["held_bins"], len(r["qps"]), r["total"]) for k, r in rows.items()} == {0: (1, 1001, None), 1: (2, 1001, 5.0), 2: (0, 1001, 0.0)}
    assert [b for b, x in enumerate(rows[1]["qps"]) if x] == [5, 1000] and rows[0]["qps"][0] is None


def test_records_stand_in_small_row_groups(spark, tmp_path):
    qp = spark.createDataFrame([(0, 1, 5, 2.0)], "sample_id long, electrode int, bin int, qps double")
    own = spark.range(1000).selectExpr("id as sample_id", "'s' as sample_name", "array(0d, 1d) as qx", "array(0d, 0d) as qy", "1d as gap", "2d as chip_z").coalesce(1)
    records = series.qp_records(qp, own)
    writers.write_run(records, str(tmp_path / "runs"), 0)
    writers.write_arrays(records, str(tmp_path / "arrays"))
    for folder in ("runs", "arrays"):  # a reader unfolds whole groups, which mostly zeros keep small on disk
        files = [pq.ParquetFile(f) for f in (tmp_path / folder).rglob("*.parquet")]
        assert sum(f.metadata.num_rows for f in files) == 1000
        assert max(f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)) <= 128


@pytest.mark.parametrize("name", ["txt9_study_documents", "txt15_study_manifest"])
def test_samples_are_not_shuffled(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(lineage, "shared_dir", lambda spark: str(tmp_path))
    plan = planned(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    exchanges = [line for line in plan.splitlines() if re.search(r"[ +-]Exchange ", line)]
    assert exchanges and not any("sample_id" in line for line in exchanges), plan
    assert "SortMergeJoin" not in plan[: plan.index("BroadcastNestedLoopJoin")] and not files_under(tmp_path), plan


def test_path_documents_are_the_rendered_documents(spark):
    params, template = catalog.catalog(spark), templates.template(spark)
    trajectories = spark.range(300).filter("id % 100 = 7").select(F.col("id").alias("traj"))
    values = design.morris_design(trajectories, params).select("sample_id", "var_idx", "value")
    fixed = study.fixed_commands(values.select("sample_id").distinct(), "Morris_", "/hits")
    expected = study.rendered_documents(template, study.swept_commands(values, params).unionByName(fixed))
    found = study.path_documents(design.morris_paths(trajectories, params), params, template, "Morris_", "/hits")
    lines = found.select("sample_id", "doc", F.inline("lines"))
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, expected.collect()))
    names = [c for c in found.columns if c not in ("sample_id", "doc", "lines")]
    ode = design.named_values(values, params, "ode").select("sample_id", *names)
    assert sorted(map(tuple, found.filter("doc = 'macro'").select("sample_id", *names).collect())) == sorted(map(tuple, ode.collect()))
    with pytest.raises(Exception, match="required command is missing"):
        study.path_documents(design.morris_paths(trajectories, params), params, template.filter("text not like '%setWidth%'"), "Morris_", "/hits").count()


def test_document_values_are_those_of_the_first_line(spark):
    lines = [(1, "# /a 0"), (2, "\t /ab 1 "), (3, "/a 2"), (4, None)]
    documents = spark.createDataFrame([(1, lines), (2, [])], "sample_id long, lines array<struct<line_no:int,text:string>>")
    rows = study.document_values(documents, {"x": "/a", "y": "/a ", "z": "/c"}).orderBy("sample_id").collect()
    assert [tuple(r) for r in rows] == [(1, "b 1", "2", None), (2, None, None, None)]


def test_packed_series_come_back_bit_by_bit(spark):
    r = np.random.default_rng(5)
    rows = np.zeros((5, 400))
    rows[1] = np.exp(-np.arange(400) / 60)
    rows[2] = r.integers(-(1 << 63), 1 << 63, 400).view(np.float64)  # any bits, NaN among them
    rows[3, :4] = [-0.0, np.inf, np.nan, 5e-324]
    sizes = np.array([400, 399, 400, 4, 0])
    parts = packing.packed(rows, sizes)
    assert packing.unpacked(parts, sizes).tobytes() == b"".join(x[:n].tobytes() for x, n in zip(rows, sizes, strict=True))
    assert len(parts[1]) < 399 * 8 / 2
    assert packing.unpacked([], np.zeros(0, np.int64)).size == 0
    own = spark.range(3).selectExpr("id as sample_id", *[f"1d as {c}" for c in series.ODE if c != "pt"], "75d + id as pt")
    qp = spark.createDataFrame([(0, 0, 3, 2.0), (1, 0, 0, 1.0), (1, 4, 1000, 3.0), (2, 1, 7, None)], "sample_id long, electrode int, bin int, qps double")
    found = [{tuple(x)[:2]: str(x) for x in f.collect()} for f in (series.dg_records(qp, own), series.unpacked(series.dg_records(qp, own, packed=True)))]
    assert len(found[0]) == 4 and found[0] == found[1]


def test_series_records_are_small_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "_fresh", lambda spark, n: str(tmp_path / n))
    points = sum(r["points"] for r in registry.QUERIES["snk6_series_records"](spark, "/root/testdata/sf0.01").collect())
    assert sum(f.stat().st_size for f in files_under(tmp_path)) < points * 16 / 4  # two doubles a point
