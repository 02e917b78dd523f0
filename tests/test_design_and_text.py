import math

import pytest
from pyspark.sql import functions as F

from effectsmith.functions.expressions import rounded
from effectsmith.operators import audit, design, effects, render

LINES = "doc string, line_no int, text string"
COMMANDS = "doc string, command string, new_line string"


def params(spark, n=3):
    return spark.createDataFrame([(i, f"p{i}", 0.0, 1.0, 1.0, "ode") for i in range(n)], "var_idx int, name string, lo double, hi double, default double, target string")


def test_trajectories_change_one_variable_a_step(spark):
    n, k = 40, 5
    rows = design.morris_design(spark.range(n).withColumnRenamed("id", "traj"), params(spark, k)).collect()
    assert len(rows) == n * (k + 1) * k
    u = {(r["traj"], r["step"], r["var_idx"]): r["u"] for r in rows}
    for t in range(n):
        moved = []
        for s in range(1, k + 1):
            delta = [(v, u[t, s, v] - u[t, s - 1, v]) for v in range(k) if u[t, s, v] != u[t, s - 1, v]]
            assert len(delta) == 1 and abs(delta[0][1]) == pytest.approx(2 / 3)
            moved.append(delta[0][0])
        assert sorted(moved) == list(range(k))
    assert {round(x * 3) for x in u.values()} == {0, 1, 2, 3}


def test_design_does_not_depend_on_partitions(spark):
    t = spark.range(20).withColumnRenamed("id", "traj")
    key = lambda df: sorted(map(tuple, df.select("traj", "step", "var_idx", "level").collect()))
    assert key(design.morris_design(t.repartition(7), params(spark))) == key(design.morris_design(t.coalesce(1), params(spark)))


def test_effects_of_a_linear_outcome(spark):
    d = design.morris_design(spark.range(10).withColumnRenamed("id", "traj"), params(spark)).cache()
    wide = d.groupBy("traj", "step").pivot("var_idx", [0, 1, 2]).agg(F.first("u"))
    y = wide.select("traj", "step", (2 * F.col("0") - F.col("1")).alias("y"))
    got = {r["var_idx"]: r for r in effects.effect_statistics(effects.elementary_effects(d, y)).collect()}
    for var, mu in ((0, 2.0), (1, -1.0), (2, 0.0)):
        assert got[var]["mu"] == pytest.approx(mu, abs=1e-9)
        assert got[var]["mu_star"] == pytest.approx(abs(mu), abs=1e-9)
        assert got[var]["sigma"] == pytest.approx(0.0, abs=1e-9)


def test_level_rounding(spark):
    frame = spark.createDataFrame([(i / 3.0,) for i in range(4)], "u double")
    levels = lambda lo, hi: [r["v"] for r in frame.select(rounded(design.scaled(F.col("u"), F.lit(lo), F.lit(hi)), 6).alias("v")).collect()]
    assert levels(191e-6 * 0.5, 191e-6 * 1.5) == [9.6e-05, 0.000159, 0.000223, 0.000286]
    assert levels(191e-6, 573e-6) == [0.000191, 0.000318, 0.000446, 0.000573]


def test_sobol_points_are_balanced(spark):
    dims = 20
    rows = design.sobol_points(spark.range(64).withColumnRenamed("id", "i"), dims).collect()
    assert [r["u"] for r in sorted((r for r in rows if r["dim"] == 0), key=lambda r: r["i"])][:4] == [0.0, 0.5, 0.75, 0.25]
    for dim in range(dims):
        # one point in each of 64 equal intervals
        assert sorted(math.floor(r["u"] * 64) for r in rows if r["dim"] == dim) == list(range(64))


def test_gaussian_design(spark):
    p = params(spark, 4)
    still = design.gaussian_design(spark.range(50).withColumnRenamed("id", "sample_id"), p, 0.0)
    assert {r["value"] for r in still.collect()} == {1.0}
    moved = design.gaussian_design(spark.range(2000).withColumnRenamed("id", "sample_id"), p, 0.1).agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).first()
    assert moved["m"] == pytest.approx(1.0, abs=0.005) and moved["s"] == pytest.approx(0.1, abs=0.005)


def test_catalogs(spark):
    groups = spark.createDataFrame([(0, "a ", [0.0], [1.0]), (1, "v ", [0.0, 1.0], [2.0, 3.0])], "grp_ord int, command string, lo array<double>, hi array<double>")
    got = [(r["var_idx"], r["name"], r["lo"]) for r in design.expanded(groups).orderBy("var_idx").collect()]
    assert got == [(0, "a ", 0.0), (1, "v _1", 0.0), (2, "v _2", 1.0)]
    risky = spark.createDataFrame([("p1",)], "name string")
    assert [(r["var_idx"], r["name"]) for r in design.safe_catalog(params(spark), risky).orderBy("var_idx").collect()] == [(0, "p0"), (1, "p2")]
    other = params(spark).filter("var_idx > 0").withColumn("hi", F.when(F.col("var_idx") == 1, 2.0).otherwise(F.col("hi")))
    verdict = {r["name"]: r["verdict"] for r in design.catalog_difference(params(spark), other, "name", ["lo", "hi"]).collect()}
    assert verdict == {"p0": "only_a", "p1": "changed", "p2": "same"}


TEMPLATE = [("m", 1, "# /a/setP 0"), ("m", 2, "/a/setPP 1"), ("m", 3, "  /a/setP 5"), ("m", 4, "#/a/setQ 2"), ("m", 5, "#/a/setQ 3")]


def text_of(df):
    return [r["text"] for r in df.orderBy("line_no").collect()]


def test_first_line_is_replaced(spark):
    lines = spark.createDataFrame(TEMPLATE, LINES)
    command = lambda c: spark.createDataFrame([("m", c, "NEW")], COMMANDS)
    assert text_of(render.replaced_first(lines, command("/a/setP ")))[2] == "NEW"
    assert text_of(render.replaced_first(lines, command("/a/setP "))).count("NEW") == 1
    assert text_of(render.replaced_first(lines, command("/a/setQ "), allow_commented=True))[3:] == ["NEW", "#/a/setQ 3"]
    assert text_of(render.replaced_first(lines, command("/a/setQ "))) == [t for _, _, t in TEMPLATE]
    assert text_of(render.replaced_first(lines, command("/a/setR "), append_if_missing=True))[5] == "NEW"
    assert render.missing_commands(lines, command("/a/setR ")).count() == 1
    assert render.missing_commands(lines, command("/a/setQ ")).count() == 1
    assert text_of(render.replaced_all(lines, command("/a/setP"))) == ["# /a/setP 0", "NEW", "  /a/setP 5", "#/a/setQ 2", "#/a/setQ 3"]


def test_values_are_read_back(spark):
    lines = spark.createDataFrame(TEMPLATE, LINES)
    asked = spark.createDataFrame([("m", "/a/setP", ""), ("m", "/a/setQ", ""), ("m", "/zz", "")], COMMANDS)
    got = {r["command"]: r["value"] for r in render.command_values(lines, asked).collect()}
    assert got == {"/a/setP": "P 1", "/a/setQ": "<missing>", "/zz": "<missing>"}


def test_rendered_documents_take_the_last_override(spark):
    template = spark.createDataFrame([("m", 1, "a"), ("m", 2, "b")], LINES)
    over = spark.createDataFrame([(7, "m", 2, "x", 1), (7, "m", 2, "y", 2)], "sample_id long, doc string, line_no int, text string, precedence int")
    assert text_of(render.rendered(template, over)) == ["a", "y"]


def test_manifest_problems(spark):
    rows = spark.createDataFrame([(1e-4, 1e-4, [1.0], [1.0]), (None, 1e-4, [1.0], [1.0]), (1e-4, 1e-4, [1.0], [1.0, 2.0]), (1e-4, 1e-4, [], [])], "gap double, chip_z double, qx array<double>, qy array<double>")
    assert [r["problem"] for r in render.checked_manifest(rows).collect()] == [None, "missing command", "site lengths differ", "no site"]


def test_audits(spark):
    rows = spark.createDataFrame([("g", i, f) for i, f in enumerate([True, True, False, True])], "g string, i int, f boolean")
    got = sorted((r["first"], r["last"], r["f"]) for r in audit.islands(rows, "g", "i", "f").collect())
    assert got == [(0, 1, True), (2, 2, False), (3, 3, True)]
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("x", 1), ("z", 1)], "k string, v int")
    verdict = {r["k"]: r["verdict"] for r in audit.compared_runs(audit.fingerprint(a, "k", ["v"]), audit.fingerprint(b, "k", ["v"]), "k").collect()}
    assert verdict == {"x": "identical", "y": "only_a", "z": "only_b"}


def test_catalog_of_the_study(spark):
    from effectsmith.sources import catalog

    rows = catalog.catalog(spark).collect()
    assert (len({r["grp_ord"] for r in rows}), len(rows)) == (50, 53)
    assert all(r["lo"] <= r["hi"] for r in rows) and [r["var_idx"] for r in rows] == list(range(53))
    assert catalog.catalog(spark, safe=True).count() == 43
    limits = design.level_census(design.morris_design(spark.range(40).withColumnRenamed("id", "traj"), catalog.catalog(spark)))
    by_name = {r["name"]: r["levels"] for r in limits.join(catalog.catalog(spark), "var_idx").collect()}
    assert by_name["/main/detector_param/setTopQPLim "] == [2.0, 3.0, 4.0, 5.0]
    assert by_name["/main/detector_param/setTopGap "] == [9.6e-05, 0.000159, 0.000223, 0.000286]
