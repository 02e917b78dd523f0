"""Designs of experiments as tables: screening trajectories, low-discrepancy points, perturbations.

A catalog is a small table (var_idx, name, lo, hi, default, is_int, target, ...); it is a parameter of the
study and is read to the driver. Everything that grows, trajectories, points and samples, is a DataFrame.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effectsmith.functions.expressions import hash_int, rounded

# Published primitive polynomials (degree, coefficients) and initial numbers of Joe and Kuo.
JOE_KUO = [
    (1, 0, [1]),
    (2, 1, [1, 3]),
    (3, 1, [1, 3, 1]),
    (3, 2, [1, 1, 1]),
    (4, 1, [1, 1, 3, 3]),
    (4, 4, [1, 3, 5, 13]),
    (5, 2, [1, 1, 5, 5, 17]),
    (5, 4, [1, 1, 5, 5, 5]),
    (5, 7, [1, 1, 7, 11, 19]),
    (5, 11, [1, 1, 5, 1, 1]),
    (5, 13, [1, 1, 1, 3, 11]),
    (5, 14, [1, 3, 5, 5, 31]),
    (6, 1, [1, 3, 3, 9, 7, 49]),
    (6, 13, [1, 1, 1, 15, 21, 21]),
    (6, 16, [1, 3, 1, 13, 27, 49]),
    (6, 19, [1, 1, 1, 15, 7, 5]),
    (6, 22, [1, 3, 1, 15, 13, 25]),
    (6, 25, [1, 1, 5, 5, 19, 61]),
    (7, 1, [1, 3, 7, 11, 23, 15, 103]),
]
# Number of each dimension behind the table (from 20), found by search: all dimensions up to it keep
# Property A (each half-open cube of side 1/2 gets one of 2^d points), and of 400 numbers it has the least worst
# two-dimensional projection onto the dimensions before it, at 2^10 points.
SEEDS = [149, 209, 34, 29, 79, 216, 228, 9, 38, 11, 49, 9, 239, 31, 4, 7, 3, 37, 101, 113, 16, 11, 258, 118, 149, 208, 214, 208, 12, 2, 117, 48, 28]
BITS = 32
BLOCK = 4096
# Rational approximation of the inverse normal distribution (Acklam), relative error below 1.15e-9.
NORMAL_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
NORMAL_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
NORMAL_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
NORMAL_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
NORMAL_TAIL = 0.02425


def is_primitive(degree: int, inner: int) -> bool:
    """Whether x^degree + ... + 1 over two elements is primitive; ``inner`` holds the coefficients between."""
    poly, x = 1 << degree | inner << 1 | 1, 1
    for k in range(1, 1 << degree):
        x <<= 1
        x ^= poly if x >> degree else 0
        if x == 1:
            return k == (1 << degree) - 1
    return False


def polynomial(number: int) -> tuple[int, int]:
    """(degree, inner coefficients) of the primitive polynomials in ascending order, from 0."""
    degree = 0
    while True:
        degree += 1
        for inner in range(1 << (degree - 1)):
            if is_primitive(degree, inner):
                if number == 0:
                    return degree, inner
                number -= 1


def initial_numbers(dim: int) -> tuple[int, int, list[int]]:
    """(degree, inner coefficients, initial numbers) of a dimension from 1 on: the published ones, then the next
    primitive polynomials with odd numbers below 2, 4, 8 ... from the hash of the dimension and its number in SEEDS."""
    if dim <= len(JOE_KUO):
        return JOE_KUO[dim - 1]
    s, a = polynomial(dim - 1)
    seed = SEEDS[dim - len(JOE_KUO) - 1]
    return s, a, [zlib.crc32(f"{dim}:{seed}:{i}".encode()) % (1 << i) * 2 + 1 for i in range(s)]


def direction_integers(dim: int, count: int) -> list[int]:
    """The first ``count`` numbers m_k < 2^k; the k-th direction number is m_k / 2^k."""
    if dim == 0:
        return [1] * count
    s, a, first = initial_numbers(dim)
    m = list(first[:count])
    for k in range(s, count):
        x = m[k - s] ^ (m[k - s] << s)
        for j in range(1, s):
            if (a >> (s - 1 - j)) & 1:
                x ^= m[k - j] << j
        m.append(x)
    return m


def directions(dim: int) -> list[int]:
    """Direction numbers of a dimension (from 0), as 32-bit integers."""
    return [m << (BITS - 1 - k) for k, m in enumerate(direction_integers(dim, BITS))]


def byte_tables(dims: int) -> list[list[list[int]]]:
    """For each byte of a Gray code and each dimension: the combined direction numbers of the byte's 256 values."""
    tables = []
    for byte in range(BITS // 8):
        own = []
        for dim in range(dims):
            v, row = directions(dim)[8 * byte : 8 * byte + 8], [0]
            for x in v:
                row += [x ^ y for y in row]
            own.append(row)
        tables.append(own)
    return tables


def expanded(groups: DataFrame) -> DataFrame:
    """Scalar variables of parameter groups (grp_ord, command, lo array, hi array): vectors give
    ``command_1`` ..., and var_idx counts them in group order."""
    each = groups.select("grp_ord", "command", F.size("lo").alias("n_elem"), F.posexplode(F.arrays_zip("lo", "hi")).alias("elem", "b"))
    name = F.when(F.col("n_elem") > 1, F.concat("command", F.lit("_"), (F.col("elem") + 1).cast("string"))).otherwise(F.col("command"))
    named = each.select("grp_ord", "elem", "n_elem", name.alias("name"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))
    # offsets by blocks of group numbers: only the blocks' totals, one row each, are summed in one task
    before = groups.select(F.col("grp_ord").alias("o"), F.size("lo").alias("k"), F.floor(F.col("grp_ord") / BLOCK).alias("block"))
    totals = before.groupBy("block").agg(F.sum("k").alias("t"))
    starts = totals.select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("start"))
    inside = F.sum("k").over(Window.partitionBy("block").orderBy("o")) - F.col("k")
    offset = before.withColumn("inside", inside).join(starts, "block").select(F.col("o").alias("grp_ord"), (F.col("start") + F.col("inside")).alias("first"))
    return named.join(offset, "grp_ord").select((F.col("first") + F.col("elem")).cast("int").alias("var_idx"), "grp_ord", "elem", "n_elem", "name", "lo", "hi")


def catalog_array(params: DataFrame, *columns: str) -> tuple[Column, int]:
    """The catalog as an array literal and its length."""
    rows = params.orderBy("var_idx").select("var_idx", *columns).collect()
    kinds = {f.name: f.dataType for f in params.schema.fields}
    make = lambda r: F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in ("var_idx", *columns)])
    return F.array(*[make(r) for r in rows]), len(rows)


def morris_design(trajectories: DataFrame, params: DataFrame, seed: str = "morris") -> DataFrame:
    """(traj, step, var_idx, level, u, value, sample_id): one variable changes in each step, once a
    trajectory, by two of the levels 0, 1/3, 2/3, 1. ``trajectories``: one column traj (from 0)."""
    listed, n = catalog_array(params, "lo", "hi")
    each = trajectories.select("traj", F.explode(listed).alias("p")).select("traj", "p.*")
    order = hash_int(F.lit(seed), F.lit("order"), F.col("traj"), F.col("var_idx"))
    bits = hash_int(F.lit(seed), F.lit("level"), F.col("traj"), F.col("var_idx"))
    flip = F.row_number().over(Window.partitionBy("traj").orderBy("o", "var_idx"))
    each = each.withColumns({"o": order, "b": bits}).withColumn("flip", flip)
    base, after = _levels(F.col("b"))
    steps = each.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    level = F.when(F.col("step") < F.col("flip"), base).otherwise(after).cast("int")
    u = F.col("level") / F.lit(3.0)
    return steps.withColumn("level", level).select(
        "traj", "step", "var_idx", "flip", "level", u.alias("u"),
        rounded(scaled(u, F.col("lo"), F.col("hi")), 6).alias("value"),
        (F.col("traj") * (n + 1) + F.col("step")).alias("sample_id"),
    )


def _levels(b: Column) -> tuple[Column, Column]:
    """The levels before and after a variable's step, by its random bits: two thirds up or down."""
    up = F.floor(b / 2) % 2 == 0
    return F.when(up, b % 2).otherwise(2 + b % 2), F.when(up, 2 + b % 2).otherwise(b % 2)


def morris_paths(trajectories: DataFrame, params: DataFrame, seed: str = "morris") -> DataFrame:
    """(traj, path): ``morris_design`` as one row a trajectory, without a shuffle. ``path`` has (var_idx, flip, before,
    after) in order of var_idx: the variable's value is ``before`` in the steps below ``flip``, then ``after``."""
    listed, _ = catalog_array(params, "lo", "hi")
    number = lambda use, p: hash_int(F.lit(seed), F.lit(use), F.col("traj"), p["var_idx"])
    drawn = lambda p: F.struct(number("order", p).alias("o"), p["var_idx"].alias("var_idx"), number("level", p).alias("b"), p["lo"].alias("lo"), p["hi"].alias("hi"))

    def moved(x: Column, i: Column) -> Column:
        before, after = (rounded(scaled(level.cast("int") / F.lit(3.0), x["lo"], x["hi"]), 6) for level in _levels(x["b"]))
        return F.struct(x["var_idx"].alias("var_idx"), (i + 1).alias("flip"), before.alias("before"), after.alias("after"))

    in_order = F.array_sort(F.transform(listed, drawn))  # by o, then var_idx
    return trajectories.select("traj", F.array_sort(F.transform(in_order, moved)).alias("path"))


def scaled(u: Column, lo: Column, hi: Column) -> Column:
    """Unit interval to bounds, in this order of operations."""
    return u * (hi - lo) + lo


def sobol_integers(indices: DataFrame, dims: int) -> DataFrame:
    """(i, ..., dim, x) of unscrambled Sobol points as 32-bit integers; ``indices``: a column i (from 0) and others.

    A Gray code is four bytes, each looked up in its table of 256 combined direction numbers: constants of the plan.
    """
    gray = F.col("i").bitwiseXOR(F.shiftright("i", 1))
    each = indices.withColumn("gray", gray).withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))))
    x = F.lit(0).cast("long")
    for byte, table in enumerate(byte_tables(dims)):
        constant = F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>")  # folded once, before execution
        x = x.bitwiseXOR(F.get(F.get(constant, F.col("dim")), F.shiftright("gray", 8 * byte).bitwiseAND(F.lit(255).cast("long")).cast("int")))
    return each.withColumn("x", x).drop("gray")


def sobol_points(indices: DataFrame, dims: int) -> DataFrame:
    """(i, dim, u) of unscrambled Sobol points; ``indices``: one column i (from 0)."""
    return sobol_integers(indices.select("i"), dims).select("i", "dim", (F.col("x") / F.lit(float(1 << BITS))).alias("u"))


def _polynomial_at(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    """The normal quantile of a probability between 0 and 1, to a relative error below 1.15e-9: a rational function in
    the middle and one of sqrt(-2 ln p) in each tail."""
    q = p - F.lit(0.5)
    r = q * q
    middle = _polynomial_at(NORMAL_A, r) * q / _polynomial_at(NORMAL_B, r)
    tail = lambda t: _polynomial_at(NORMAL_C, t) / _polynomial_at(NORMAL_D, t)
    root = lambda x: F.sqrt(F.lit(-2.0) * F.log(x))
    return F.when(p < NORMAL_TAIL, tail(root(p))).when(p > 1 - NORMAL_TAIL, -tail(root(F.lit(1.0) - p))).otherwise(middle)


def digital_shift(seed: str, dim: int) -> int:
    """32 bits that move all points of a dimension: the net keeps its balance and no point is 0."""
    return zlib.crc32(f"{seed}:{dim}".encode())


def gaussian_design(samples: DataFrame, params: DataFrame, fraction: float, seed: str = "gauss") -> DataFrame:
    """(sample_id, var_idx, value): defaults moved by ``fraction`` of their size times a normal number.

    The normal numbers are quantiles of Sobol points, moved by a digital shift: sample i is point i, so any 2^k
    samples in a row are spread evenly in every variable. ``samples``: one column sample_id, from 0."""
    rows = params.orderBy("var_idx").select("var_idx", "default").collect()  # the catalog, a parameter of the study
    points = sobol_integers(samples.select("sample_id", F.col("sample_id").alias("i")), len(rows))
    constants = F.array(*[F.struct(F.lit(r["var_idx"]).cast("int").alias("var_idx"), F.lit(r["default"]).alias("m"), F.lit(digital_shift(seed, k)).cast("long").alias("shift")) for k, r in enumerate(rows)])
    each = points.select("sample_id", "x", F.get(constants, F.col("dim")).alias("p")).select("sample_id", "x", "p.*")
    u = (F.col("x").bitwiseXOR(F.col("shift")) + F.lit(0.5)) / F.lit(float(1 << BITS))
    value = F.col("m") + F.lit(fraction) * F.abs("m") * inverse_normal(u)
    return each.select("sample_id", "var_idx", rounded(value, 7).alias("value"))


def mean_from_bound(lo: Column, factor: float) -> Column:
    return lo / F.lit(factor)


def derived_double(design: DataFrame, source_idx: int, target_idx: int) -> DataFrame:
    """Sets the target variable of each sample to twice the source variable."""
    w = Window.partitionBy("sample_id")
    source = F.max(F.when(F.col("var_idx") == source_idx, F.col("value"))).over(w)
    return design.withColumn("value", F.when(F.col("var_idx") == target_idx, 2 * source).otherwise(F.col("value")))


def safe_catalog(params: DataFrame, risky: DataFrame) -> DataFrame:
    """Catalog without the risky groups, variables numbered anew."""
    kept = params.join(risky.select("name").distinct(), "name", "left_anti")
    return kept.withColumn("var_idx", (F.row_number().over(Window.orderBy("var_idx")) - 1).cast("int"))


def catalog_difference(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer comparison of two catalogs or documents: only_a, only_b, changed or same."""
    left = a.select(key, F.struct(*columns).alias("a"))
    right = b.select(key, F.struct(*columns).alias("b"))
    verdict = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return left.join(right, key, "full_outer").select(key, verdict.alias("verdict"))


def sample_name(prefix: str, sample_id: Column) -> Column:
    return F.concat(F.lit(prefix), sample_id.cast("string"))


def first_samples(design: DataFrame, most: int) -> DataFrame:
    """The first ``most`` samples by number; all for 0."""
    return design.filter(F.col("sample_id") < most) if most > 0 else design


def named_values(design: DataFrame, params: DataFrame, target: str) -> DataFrame:
    """One column for each variable of a target, one row a sample."""
    names = [r["name"] for r in params.filter(F.col("target") == target).orderBy("var_idx").select("name").collect()]
    rows = design.join(F.broadcast(params.select("var_idx", "name")), "var_idx").filter(F.col("name").isin(names))
    return rows.groupBy("sample_id").pivot("name", names).agg(F.first("value"))


def design_counts(design: DataFrame) -> DataFrame:
    return design.agg(F.count_distinct("sample_id").alias("samples"), F.count_distinct("var_idx").alias("variables"), F.count("*").alias("cells"))


def level_census(design: DataFrame) -> DataFrame:
    """Distinct values drawn for each variable, ascending, with their number."""
    once = design.select("var_idx", "value").distinct()
    return once.groupBy("var_idx").agg(F.count("*").alias("n_levels"), F.array_sort(F.collect_list("value")).alias("levels"))
