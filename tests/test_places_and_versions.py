import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from effectsmith.operators import asof, audit, compare, design, render, sites

# --- nearest and as-of ----------------------------------------------------------------------------


def nearest_of(value, grid):
    if value is None or math.isnan(value) or not grid:
        return None
    return min(grid, key=lambda g: (abs(g - value), g))


@pytest.mark.parametrize("ranges", [1, 7])
def test_nearest_equals_brute_force(spark, ranges):
    r = random.Random(4)
    grid = sorted({round(r.uniform(-5, 5), 1) for _ in range(40)})
    values = [None, float("nan"), -100.0, 100.0, *grid[:5], *(round(r.uniform(-6, 6), 2) for _ in range(300)), *([0.25] * 50)]
    points = spark.createDataFrame(list(enumerate(values)), "id long, at double")
    frame = spark.createDataFrame([(g, str(g), k) for k, g in enumerate([*grid, *grid])], "at double, name string, k int")
    got = {x["id"]: x["nearest"] for x in asof.nearest(points, frame, "at", ranges=ranges).collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        expected = nearest_of(v, grid)
        assert (got[i] and got[i]["at"]) == expected
        if expected is not None:
            assert got[i]["k"] == grid.index(expected)  # of equal grid places the least


def test_as_of_by_key_reaches_over_ranges(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "a", "a", "b", "c", None]), r.randint(0, 200), r.random() < 0.1) for _ in range(600)]
    points = spark.createDataFrame([(i, k, t) for i, (k, t, g) in enumerate(rows) if not g], "id long, k string, at long")
    grid = spark.createDataFrame([(k, t) for k, t, g in rows if g], "k string, at long")
    got = {x["id"]: x["before"] and x["before"]["at"] for x in asof.as_of(points, grid, "at", ["k"], ranges=9).collect()}
    for i, (k, t, g) in enumerate(rows):
        if not g:
            earlier = [t2 for k2, t2, g2 in rows if g2 and k2 == k and k is not None and t2 <= t]
            assert got[i] == (max(earlier) if earlier else None)


def test_nearest_without_points_or_grid(spark):
    points, grid = spark.createDataFrame([(1, 2.0)], "id long, at double"), spark.createDataFrame([(2.0, 1)], "at double, k int")
    assert asof.nearest(points, grid.limit(0), "at").first()["nearest"] is None
    assert asof.nearest(points.limit(0), grid, "at").count() == 0


def test_nearest_of_ten_thousand_sites(spark):
    r = random.Random(6)
    places = [(i, r.gauss(0, 1) if i % 3 else r.uniform(-50, 50), r.gauss(0, 1) if i % 3 else r.uniform(-50, 50)) for i in range(10_000)]
    places += [(10_000 + i, x, y) for i, (_, x, y) in enumerate(places[:50])]  # the same places again, later
    points = [(i, r.uniform(-60, 60), r.uniform(-60, 60)) for i in range(150)] + [(200 + i, places[i][1], places[i][2]) for i in range(20)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 1e6, -1e6)]
    got = {x["point_id"]: (x["site"], x["distance"]) for x in sites.nearest_site(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(places, "site long, sx double, sy double")).collect()}
    assert got[900] == got[901] == (None, None)
    for i, x, y in points:
        if i not in (900, 901):
            d, site = min((math.sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), s) for s, sx, sy in places)
            assert got[i] == (site, d)


def test_nearest_site_equals_the_array_form(spark):
    from effectsmith.functions.expressions import nearest_site
    from effectsmith.plans.derived import QX, QY

    r = random.Random(7)
    points = [(i, r.randint(-16, 16) / 4, r.randint(-16, 16) / 4) for i in range(300)]  # many ties
    frame = spark.createDataFrame(points, "point_id long, x double, y double")
    arrays = {x["point_id"]: x["site"] for x in frame.select("point_id", nearest_site(F.col("x"), F.col("y"), F.array(*[F.lit(float(q)) for q in QX]), F.array(*[F.lit(float(q)) for q in QY])).alias("site")).collect()}
    table = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(QX, QY, strict=True))], "site long, sx double, sy double")
    assert {x["point_id"]: x["site"] for x in sites.nearest_site(frame, table).collect()} == arrays
    assert sites.nearest_site(frame, table.limit(0)).filter("site is null").count() == 300
    assert sites.nearest_site(frame, table.limit(1)).filter("site = 0").count() == 300


# --- versions -------------------------------------------------------------------------------------


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_a_common_order(spark):
    r = random.Random(8)
    a, b = {}, {}
    for doc in range(60):
        unique = doc % 2 == 0
        lines = [f"l{doc}-{i}" if unique else r.choice(["", "x", f"y{i}", f"y{i % 5}"]) for i in range(r.randint(0, 25))]
        other = lines.copy()
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(other))
            what = r.randrange(3)
            if what == 0:
                other.insert(k, r.choice(["new", "", "x"]) + str(k) * unique)
            elif other and what == 1:
                other.pop(min(k, len(other) - 1))
            elif other:
                i, j = r.randrange(len(other)), r.randrange(len(other))
                other[i], other[j] = other[j], other[i]
        a[doc], b[doc] = lines, other
    a[100], b[101], a[102], b[102] = ["only"], ["other"], [], []
    frame = lambda v: spark.createDataFrame([(d, i + 1, t) for d, ls in v.items() for i, t in enumerate(ls)], "doc long, line_no int, text string")
    rows = compare.aligned_lines(frame(a), frame(b)).collect()
    for doc in {*a, *b}:
        own = [x for x in rows if x["doc"] == doc]
        x, y = a.get(doc, []), b.get(doc, [])
        equal = sorted((e["line_a"], e["line_b"]) for e in own if e["verdict"] == "equal")
        assert all(x[i - 1] == y[j - 1] for i, j in equal)
        assert all(p[1] < q[1] for p, q in itertools.pairwise(equal))
        assert sorted([i for i, _ in equal] + [e["line_a"] for e in own if e["verdict"] == "deleted"]) == list(range(1, len(x) + 1))
        assert sorted([j for _, j in equal] + [e["line_b"] for e in own if e["verdict"] == "inserted"]) == list(range(1, len(y) + 1))
        if len(set(x)) == len(x) and len(set(y)) == len(y):
            assert len(equal) == longest_common(x, y)


def test_longest_increasing():
    import numpy as np

    r = random.Random(9)
    for _ in range(200):
        v = r.sample(range(30), r.randint(0, 9))
        kept = [v[i] for i in compare.longest_increasing(np.array(v, dtype=np.int64))]
        assert kept == sorted(kept)
        assert len(kept) == max((n for n in range(len(v) + 1) for c in itertools.combinations(v, n) if list(c) == sorted(c)), default=0)


def test_multiset_difference(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k long, t string")
    a, b = frame([(1, "x"), (1, "x"), (2, None), (3, "y")]), frame([(1, "x"), (2, None), (4, "z"), (4, "z")])
    assert {tuple(r) for r in compare.multiset_difference(a, b, ["k", "t"]).collect()} == {(1, "x", 1), (3, "y", 1), (4, "z", -2)}


# --- commands ---------------------------------------------------------------------------------------

LINES, COMMANDS = "doc long, line_no int, text string", "doc long, command string, new_line string"


def by_hand(lines, commands, commented):
    """First line of each command by the rule, line by line."""
    out = {}
    for doc, command, _ in commands:
        key = command.strip()
        fits = lambda t: t.startswith(key) and (len(t) == len(key) or t[len(key)].isspace())  # noqa: E731, B023
        found = [(False, n) for d, n, t in lines if d == doc and not t.lstrip().startswith("#") and fits(t.lstrip())]
        found += [(True, n) for d, n, t in lines if commented and d == doc and t.lstrip().startswith("#") and fits(t.lstrip()[1:].lstrip())]
        out[doc, command] = min(found)[1] if found else None
    return out


@pytest.mark.parametrize("commented", [False, True])
def test_prefix_join_equals_the_rule(spark, commented):
    r = random.Random(10)
    words = ["/a/set", "/a/setP", "stiffness", "1", "2", "#", " ", "dyn", "\t", "x.y"]
    lines = [(d, n, "".join(r.choice(["", " ", "#"])) + r.choice(["", " "]).join(r.choices(words, k=r.randint(0, 4)))) for d in range(12) for n in range(1, 15)]
    commands = sorted({(d, " ".join(r.choices(words[:4] + ["dyn"], k=r.randint(1, 3))) + r.choice(["", " "]), "new") for d in range(13) for _ in range(6)})
    got = render.hits_of(spark.createDataFrame(lines, LINES), spark.createDataFrame(commands, COMMANDS), commented).collect()
    assert {(x["doc"], x["command"]): x["line_no"] for x in got} == by_hand(lines, commands, commented)


def test_ten_thousand_commands_meet_one_long_document_by_key(spark):
    n = 10_000
    lines = spark.range(2 * n).selectExpr("1L as doc", "cast(id + 1 as int) as line_no", "concat('/p/set', id, ' 1') as text")
    commands = spark.range(n).selectExpr("1L as doc", "concat('/p/set', 2 * id) as command", "concat('/p/set', 2 * id, ' 7') as new_line")
    found = render.hits_of(lines, commands, False)
    assert found.filter("line_no = 2 * cast(substring(command, 7) as int) / 2 + 1").count() == n
    plan = render.prefix_pairs(lines, commands.select("doc", "command"), "text", True)._jdf.queryExecution().optimizedPlan().toString()
    assert "(command" in plan.split("Join Inner", 1)[1].split("\n", 1)[0]


def test_strict_rendering_stops_with_the_command(spark):
    lines = spark.createDataFrame([(1, 1, "/a/setP 1"), (1, 2, "# /a/setQ 2")], LINES)
    commands = spark.createDataFrame([(1, "/a/setP ", "/a/setP 5"), (1, "/a/setQ ", "/a/setQ 6")], COMMANDS)
    strict = render.replaced_first(lines, commands, required=True)
    for action in (strict.collect, strict.count, lambda: strict.select("doc").distinct().collect()):  # whatever is pruned
        with pytest.raises(Exception, match="/a/setQ"):
            action()
    fine = render.replaced_first(lines, commands, allow_commented=True, required=True).orderBy("line_no").collect()
    assert [x["text"] for x in fine] == ["/a/setP 5", "/a/setQ 6"]
    assert [x["command"] for x in render.missing_commands(lines, commands).collect()] == ["/a/setQ "]
    nowhere = spark.createDataFrame([(2, "/a/setP ", "x")], COMMANDS)  # a document without any line
    with pytest.raises(Exception, match="/a/setP"):
        render.replaced_first(lines, nowhere, required=True).count()


def test_strict_manifest(spark):
    rows = spark.createDataFrame([("A", 1.0, 1.0, [1.0], [1.0]), ("B", None, 1.0, [1.0], [1.0])], "sample_name string, gap double, chip_z double, qx array<double>, qy array<double>")
    assert render.checked_manifest(rows).filter("problem is not null").count() == 1
    assert render.checked_manifest(rows.filter("gap is not null"), strict=True).count() == 1
    with pytest.raises(Exception, match="B: missing command"):
        render.checked_manifest(rows, strict=True).count()


# --- designs ----------------------------------------------------------------------------------------


def independent(rows):
    basis = []
    for v in rows:
        for b in basis:
            v = min(v, v ^ b)
        if not v:
            return False
        basis.append(v)
    return True


def test_property_a_of_all_dimensions():
    dims = 53
    first_digits = [sum(((m >> k) & 1) << k for k, m in enumerate(design.direction_integers(d, dims))) for d in range(dims)]
    for d in range(1, dims + 1):
        assert independent([row & ((1 << d) - 1) for row in first_digits[:d]])


def test_pairs_of_dimensions_are_balanced(spark):
    points = {}
    for x in design.sobol_points(spark.range(1024).withColumnRenamed("id", "i"), 53).collect():
        points.setdefault(x["dim"], {})[x["i"]] = x["u"]
    # t-value 6 at 2^10 points: every box of sides 2^-a and 2^-b with a + b = 4 holds 2^6 of them
    for d, e in itertools.combinations(range(53), 2):
        for a in range(5):
            held = {}
            for i in range(1024):
                cell = (int(points[d][i] * 2**a), int(points[e][i] * 2 ** (4 - a)))
                held[cell] = held.get(cell, 0) + 1
            assert set(held.values()) == {64}, (d, e, a)


def test_inverse_normal(spark):
    p = [1e-10, 0.001, 0.02, 0.0243, 0.1, 0.3, 0.5, 0.77, 0.976, 0.9999, 1 - 1e-9]
    got = [x["z"] for x in spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double").select("i", design.inverse_normal(F.col("p")).alias("z")).orderBy("i").collect()]
    assert got == pytest.approx([statistics.NormalDist().inv_cdf(v) for v in p], rel=2e-9, abs=1e-12)


def star_discrepancy(points):
    n, worst = len(points), 0.0
    for x in [p[0] for p in points] + [1.0]:
        inside = [q for q in points if q[0] <= x]
        for y in [p[1] for p in points] + [1.0]:
            upto = sum(q[1] <= y for q in inside) / n
            below = sum(q[0] < x and q[1] < y for q in inside) / n
            worst = max(worst, abs(upto - x * y), abs(below - x * y))
    return worst


def test_quasi_random_normal_numbers_beat_hashed_ones(spark):
    from effectsmith.functions.expressions import hash_int

    n, dims = 256, 6
    params = spark.createDataFrame([(k, 1.0) for k in range(dims)], "var_idx int, default double")
    samples = spark.range(n).withColumnRenamed("id", "sample_id")
    rows = design.gaussian_design(samples, params, 1.0).collect()
    own = {(x["var_idx"], x["sample_id"]): x["value"] - 1.0 for x in rows}
    u1 = (hash_int(F.lit("a"), F.col("sample_id"), F.col("k")) + 1) / F.lit(2.0**32 + 1)
    u2 = hash_int(F.lit("b"), F.col("sample_id"), F.col("k")) / F.lit(2.0**32)
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
    hashed = {(x["k"], x["sample_id"]): x["z"] for x in samples.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(dims - 1)))).select("k", "sample_id", z.alias("z")).collect()}
    cdf = statistics.NormalDist().cdf

    def errors(v):
        mean = max(abs(statistics.fmean(v[k, i] for i in range(n))) for k in range(dims))
        spread = max(abs(statistics.pstdev([v[k, i] for i in range(n)]) - 1) for k in range(dims))
        worst = max(star_discrepancy([(cdf(v[d, i]), cdf(v[e, i])) for i in range(n)]) for d, e in [(0, 1), (2, 5)])
        return mean, spread, worst

    ours, theirs = errors(own), errors(hashed)
    assert all(a < b / 2 for a, b in zip(ours, theirs, strict=True)), (ours, theirs)


# --- quantiles ----------------------------------------------------------------------------------------


def test_quantiles_are_within_the_rank_error(spark):
    n = 60_000
    runs = spark.range(n).selectExpr("case when id % 3 = 0 then 'ok' when id % 3 = 1 then 'teardown' else 'failed' end as class", "if(id % 1000 = 7, null, cast((id * 7919) % 60013 as double)) as wall_s")
    rows = {(x["class"], x["probability"]): x for x in audit.run_quantiles(runs, "wall_s", [0.5, 0.99]).collect()}
    assert len(rows) == 8
    for (name, p), x in rows.items():
        values = sorted(v["wall_s"] for v in (runs if name == "all" else runs.filter(F.col("class") == name)).filter("wall_s is not null").select("wall_s").collect())
        assert x["n"] == len(values)
        below = sum(v <= x["quantile"] for v in values) / len(values)
        assert abs(below - p) <= audit.RANK_ERROR
        assert x["crash_rate"] == (pytest.approx(0.5, abs=1e-3) if name == "all" else None)
    assert audit.run_quantiles(runs.limit(0), "wall_s", [0.5]).filter("class <> 'all'").count() == 0
