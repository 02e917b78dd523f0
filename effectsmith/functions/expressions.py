"""Column expressions with the numeric and text rules of the study."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS, BIN_NS = 1001, 300.0
H_EV_S = 4.135667696e-15
DT_US = 0.3


def rounded(x: Column, places: int) -> Column:
    """Half-even rounding of the scaled double."""
    scale = F.lit(float(10**places))
    return F.rint(x * scale) / scale


def is_close(x: Column, y: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """abs(x - y) <= atol + rtol * abs(y); false where either is null or NaN."""
    fine = ~F.isnan(x) & ~F.isnan(y)
    return F.coalesce(fine & (F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)), F.lit(False))


def nearest_bin(t_ns: Column) -> Column:
    """Bin of the nearest grid point; ties go to the lower bin, times out of range to the edge bins."""
    raw = F.ceil(t_ns / F.lit(BIN_NS) - F.lit(0.5))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(BINS - 1)).cast("int")


def nearest_site(x_mm: Column, y_mm: Column, qx: Column, qy: Column) -> Column:
    """Index of the site of least distance, lowest index on ties; null without sites."""
    # one pass: the distances stand with their index, so they are not computed again to find it
    def place(a: Column, i: Column) -> Column:
        b = F.get(qy, i)
        far = F.sqrt((x_mm - a) * (x_mm - a) + (y_mm - b) * (y_mm - b))
        return F.when(x_mm.isNotNull() & y_mm.isNotNull() & a.isNotNull() & b.isNotNull(), F.struct(far.alias("far"), i.alias("i")))

    return F.when(F.size(qx) > 0, F.array_min(F.transform(qx, place))["i"].cast("int"))


def float_text(x: Column) -> Column:
    """A double as Python prints it: exponent form below 1e-4 or from 1e16 on, else plain, ``.0`` if whole."""
    text = x.cast("string")
    mantissa = F.regexp_replace(F.split(text, "E")[0], r"\.0$", "")
    exponent = F.split(text, "E")[1].cast("int")
    scientific = F.concat(mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    size = F.abs(x)
    return (
        F.when(F.isnan(x), "nan")
        .when(x == 0, F.when(text.startswith("-"), "-0.0").otherwise("0.0"))
        .when((size < 1e-4) | (size >= 1e16), scientific)
        .otherwise(plain)
    )


def duration_text(seconds: Column) -> Column:
    """``1h 02m 03s``, ``2m 03s`` or ``3s``; truncated, never below zero."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r))
        .when(m > 0, F.format_string("%dm %02ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def hash_fraction(seed: Column, name: Column) -> Column:
    """First 8 bytes of SHA-256 of ``seed:name`` as a fraction of 2^64."""
    first = F.conv(F.substring(F.sha2(F.concat(seed, F.lit(":"), name), 256), 1, 16), 16, 10)
    return first.cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def keeps_log(mode: Column, fraction: Column, seed: Column, name: Column) -> Column:
    """Whether the log of a successful sample is kept: always, never, or by its hash."""
    return F.when(mode == "full", F.lit(True)).when(mode.isin("failures", "none"), F.lit(False)).otherwise(hash_fraction(seed, name) < fraction)


def hash_int(*parts: Column) -> Column:
    """A non-negative number below 2^32 from text: equal on every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
