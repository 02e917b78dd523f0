import os

import pytest

from effectsmith.functions.lineage import written
from effectsmith.operators import hits as op
from effectsmith.sources import readers, writers
from effectsmith.streaming import hits_stream
from tests.test_hits_and_series import HITS, ROWS, manifest


def test_hits_csv_columns_are_found_by_header(spark, tmp_path):
    (tmp_path / "Morris_3_hitsfile.txt").write_text("End X [m],End Y [m],End Z [m],Final Time [ns],Energy Deposited [eV]\n0.1,0.2,0.3,5,1e-4\n")
    (tmp_path / "Morris_4_hitsfile.txt").write_text("End X [m],End Y [m],End Z [m],Final Time [ns],Energy Deposited [eV]\n")
    rows = readers.hits_csv(spark, str(tmp_path)).collect()
    assert [(r["sample_name"], r["x_m"], r["energy_ev"]) for r in rows] == [("Morris_3", 0.1, 1e-4)]
    listed = {r["sample_name"]: r["length"] for r in readers.file_listing(spark, str(tmp_path)).collect()}
    assert set(listed) == {"Morris_3", "Morris_4"}


def test_manifest_skips_blank_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"sample_name":"A","gap":1e-4,"qx":[1.0,2.0]}\n\n{"sample_name":"B"}\n')
    assert [r["sample_name"] for r in readers.manifest_jsonl(spark, str(tmp_path)).orderBy("sample_name").collect()] == ["A", "B"]


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.mac").write_text("x 1\n\n# y")
    assert [(r["line_no"], r["text"]) for r in readers.text_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(1, "x 1"), (2, ""), (3, "# y")]
    (tmp_path / "b.mac").write_text("x\n\n")
    named = readers.text_lines(spark, str(tmp_path), r"/([^/]+)\.mac$").filter("doc = 'b'").orderBy("line_no").collect()
    assert [tuple(r) for r in named] == [("b", 1, "x"), ("b", 2, "")]


def test_fresh_run_and_overwrite(spark, tmp_path):
    frame = spark.createDataFrame([(1, [1.0])], "k long, v array<double>")
    writers.write_fresh(frame, str(tmp_path / "runs"), "r1")
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_fresh(frame, str(tmp_path / "runs"), "r1")
    for _ in range(2):
        writers.write_arrays(frame, str(tmp_path / "arrays"))
    assert spark.read.parquet(str(tmp_path / "arrays")).count() == 1


def test_documents_by_sample(spark, tmp_path):
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "sample_id long, line_no int, text string")
    writers.write_documents(lines, str(tmp_path / "d"), "sample_id")
    folder = tmp_path / "d" / "sample_id=1"
    (name,) = [f for f in os.listdir(folder) if f.startswith("part")]
    assert (folder / name).read_text() == "a\nb\n"


def test_stream_equals_batch_and_may_be_run_again(spark, tmp_path):
    hits = spark.createDataFrame(ROWS, HITS)
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    hits.repartition(4).write.parquet(src)
    expected = sorted(map(tuple, op.histogram(hits, manifest(spark)).collect()))
    for _ in range(2):
        hits_stream.start(spark, src, manifest(spark), out, state, files_per_batch=1).awaitTermination()
        assert sorted(map(tuple, hits_stream.state(spark, out).collect())) == expected
    hits.write.mode("append").parquet(src)
    hits_stream.start(spark, src, manifest(spark), out, state).awaitTermination()
    assert sorted((*k, 2 * n) for *k, n in expected) == sorted(map(tuple, hits_stream.state(spark, out).collect()))


def test_written_tables_can_be_read_again(spark):
    frame = written(spark.range(10), "t")
    assert frame.count() == 10 and frame.filter("id > 5").count() == 4


HEADER = "End X [m],End Y [m],End Z [m],Final Time [ns],Energy Deposited [eV]"


def test_broken_hits_files_are_told_apart(spark, tmp_path):
    files = {
        "Good": f"{HEADER}\n1,2,3,4,5\n1,,3,NaN,5\n", "Order": '"Energy Deposited [eV]",Event,"Final Time [ns]","End Z [m]","End Y [m]","End X [m]"\r\n5,7,4,3,2,1\r\n',
        "Cut": f"{HEADER}\n1,2,3\n1,2,3,4,5\n1,2,3,4,5,6\n", "Word": f"{HEADER}\n1,2,x,4,5\n", "Zero": "", "Blank": "\n \n", "Bare": "1,2,3,4,5\n1,2,3,4,5\n", "Only": f"{HEADER}\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}_hitsfile.txt").write_text(text)
    rows, rejects = readers.hits_csv_checked(spark, str(tmp_path))
    got = sorted((r["sample_name"], r["x_m"], str(r["y_m"]), r["z_m"], str(r["t_ns"]), r["energy_ev"]) for r in rows.collect())
    good = (1.0, "2.0", 3.0, "4.0", 5.0)
    assert got == [("Cut", *good), ("Good", *good), ("Good", 1.0, "None", 3.0, "nan", 5.0), ("Order", *good)]
    assert sorted((r["sample_name"], r["reason"], r["text"]) for r in rejects.collect()) == [
        ("Bare", "no header", None), ("Blank", "empty file", None), ("Cut", "short row", "1,2,3"), ("Cut", "short row", "1,2,3,4,5,6"), ("Only", "no rows", None), ("Word", "not a number", "1,2,x,4,5"), ("Zero", "empty file", None),
    ]


def test_totals_in_state_follow_arriving_files(spark, tmp_path):
    own = manifest(spark)
    folder, out, state = tmp_path / "hits", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    columns = ["x_m", "y_m", "z_m", "t_ns", "energy_ev"]
    name = own.first()["sample_name"]
    lines = [",".join(repr(float(r[HITS.split(", ").index(next(h for h in HITS.split(", ") if h.startswith(c + " ")))])) for c in columns) for r in ROWS]
    seen = []
    for n, part in enumerate((lines[:2], lines[2:3], [], lines[3:])):  # one more file each time, one without rows
        if part or n == 2:
            (folder / f"{n}-{name}_hitsfile.txt").write_text("\n".join([HEADER, *part]) + "\n")
        hits_stream.start_totals(spark, str(folder), own, out, state, files_per_batch=1, pattern=r"[0-9]+-([^/]+?)_hitsfile").awaitTermination()
        seen += part
        frame = spark.createDataFrame([ROWS[lines.index(x)] for x in seen], HITS)
        expected = {tuple(r) for r in op.assigned(op.surface_hits(op.with_manifest(frame, own))).groupBy("sample_id", "electrode").agg({"qps": "sum", "*": "count"}).select("sample_id", "electrode", "sum(qps)", "count(1)").collect()}
        assert {tuple(r) for r in hits_stream.totals(spark, out).collect()} == expected
    before = sorted(os.listdir(out))
    hits_stream.start_totals(spark, str(folder), own, out, state, pattern=r"[0-9]+-([^/]+?)_hitsfile").awaitTermination()
    assert sorted(os.listdir(out)) == before  # nothing new, nothing done


def test_only_recomputed_samples_are_replaced(spark, tmp_path):
    path = str(tmp_path / "records")
    frame = lambda rows: spark.createDataFrame(rows, "sample_id long, v array<double>")
    writers.write_samples(frame([(k, [float(k)]) for k in range(5)]), path)
    files = {k: sorted(os.listdir(f"{path}/sample_id={k}")) for k in range(5)}
    times = {k: os.path.getmtime(f"{path}/sample_id={k}/{files[k][-1]}") for k in range(5)}
    for _ in range(2):  # and again
        writers.write_samples(frame([(1, [10.0]), (3, [])]), path)
    now = {r["sample_id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert now == {0: [0.0], 1: [10.0], 2: [2.0], 3: [], 4: [4.0]}
    for k in (0, 2, 4):
        assert sorted(os.listdir(f"{path}/sample_id={k}")) == files[k] and os.path.getmtime(f"{path}/sample_id={k}/{files[k][-1]}") == times[k]


def test_whole_records(spark):
    from effectsmith.operators import series

    own = manifest(spark)
    qp = op.histogram(spark.createDataFrame(ROWS, HITS), own)
    record = series.qp_records(qp, own).first()
    assert len(record["times"]) == 1001 and record["times"][-1] == 300000.0
    assert [len(x) for x in record["qp_nos"]] == [1001] * len(record["qx"])
    assert {(k, b): v for k, row in enumerate(record["qp_nos"]) for b, v in enumerate(row) if v} == {(r["electrode"], r["bin"]): r["qps"] for r in qp.collect() if r["qps"]}
    empty = series.qp_records(qp.limit(0), own).first()
    assert sum(map(sum, empty["qp_nos"])) == 0


def test_summary_file_has_the_study_header(spark, tmp_path):
    row = spark.createDataFrame([("A", 1e-4, 3, [1.0, 2.0], 3.0, 4.0, 5.0)], "sample_name string, top_gap_ev double, num_surface_hits long, electrode_qps array<double>, total_qps double, peak_dg_mhz double, total_integrated_dg double")
    writers.write_summary_csv(row, 2, str(tmp_path / "s"))
    (name,) = [f for f in os.listdir(tmp_path / "s") if f.endswith(".csv")]
    assert (tmp_path / "s" / name).read_text().splitlines()[0] == "sample_name,top_gap_eV,num_surface_hits,electrode_0_QPs,electrode_1_QPs,total_QPs,peak_DG_MHz,total_integrated_DG"
    assert readers.summary_csv(spark, str(tmp_path / "s"), 2).first()["total_integrated_dg"] == 5.0


# --- documents of the study ---


def test_study_documents_by_hand(spark):
    from effectsmith.functions.expressions import float_text
    from effectsmith.operators import design, study
    from effectsmith.sources import catalog, templates

    params = catalog.catalog(spark)
    values = design.morris_design(spark.range(1).withColumnRenamed("id", "traj"), params).filter("sample_id < 2").select("sample_id", "var_idx", "value")
    fixed = study.fixed_commands(values.select("sample_id").distinct(), "Morris_", "/hits")
    template = templates.template(spark)
    commands = study.swept_commands(values, params).unionByName(fixed)
    lines = study.rendered_documents(template, commands).filter("sample_id = 1").orderBy("doc", "line_no").collect()
    drawn = {r["var_idx"]: r["value"] for r in values.filter("sample_id = 1").collect()}
    text = {r["value"]: r["t"] for r in values.select("value", float_text(values["value"]).alias("t")).collect()}
    assert all(float(t) == v and t == repr(v) for v, t in text.items())
    macro = [r["text"] for r in lines if r["doc"] == "macro"]
    expected = templates.macro_lines()

    def replace(docs, command, new, commented):
        key = command.strip()
        for hidden in (False, True)[: 1 + commented]:
            for i, line in enumerate(docs):
                bare = line.lstrip()
                if bare.startswith("#") == hidden:
                    bare = bare[1:].lstrip() if hidden else bare
                    if bare.startswith(key) and (len(bare) == len(key) or bare[len(key)].isspace()):
                        docs[i] = new
                        return
        assert not commented
        docs.append(new)

    replace(expected, "/g4cmp/HitsFile", "/g4cmp/HitsFile /hits/Morris_1_hitsfile.txt", True)
    replace(expected, "/main/detector_param/setSubstrateG4Name", "/main/detector_param/setSubstrateG4Name G4_Si", True)
    replace(expected, "/main/detector_param/setSubstrateName", "/main/detector_param/setSubstrateName Si", True)
    for command, line in catalog.PINNED.items():
        replace(expected, command, line, True)
    k, config = 0, templates.config_lines()
    for group in [*catalog.ELECTRODE, *catalog.DETECTOR, *catalog.TRANSPORT]:
        value = str(round(drawn[k])) if group[2] == "int" else repr(drawn[k]) + group[2]
        replace(expected, group[0], group[0] + value, True)
        k += 1
    for group in catalog.CONFIG:
        n = len(group[1]) if isinstance(group[1], list) else 1
        replace(config, group[0], f"{group[0]} " + " ".join(repr(drawn[k + i]) for i in range(n)) + group[2], False)
        k += n
    assert macro == expected
    assert [r["text"] for r in lines if r["doc"] == "config"] == config
    with pytest.raises(Exception, match="required command is missing from the template: /main/electrode_param/setWidth"):
        study.rendered_documents(template.filter("text not like '%setWidth%'"), commands).count()
