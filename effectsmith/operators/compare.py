"""Differences of two tables as multisets, and of two versions of documents line by line."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n): how many times more a row stands in ``a`` (n > 0) or in ``b`` (n < 0); rows that stand as often in
    both are left out. Nulls are equal. One shuffle after partial sums."""
    signed = a.select(*columns, F.lit(1).alias("n")).unionByName(b.select(*columns, F.lit(-1).alias("n")))
    return signed.groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0")


def longest_increasing(values: np.ndarray) -> np.ndarray:
    """Places of a longest strictly increasing subsequence, by piles as in patience; of several the one with the
    least values at the end."""
    tails, places, before = np.empty(len(values), dtype=np.int64), np.empty(len(values), dtype=np.int64), np.full(len(values), -1, dtype=np.int64)
    n = 0
    for i, v in enumerate(values):
        k = int(np.searchsorted(tails[:n], v))
        tails[k], places[k] = v, i
        before[i] = places[k - 1] if k else -1
        n = max(n, k + 1)
    out, at = np.empty(n, dtype=np.int64), places[n - 1] if n else -1
    for k in range(n - 1, -1, -1):
        out[k] = at
        at = before[at]
    return out


def anchors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, line_a, line_b): lines that stand once in each version, in the longest order that both share.

    Only line numbers of such lines come together by document, 16 bytes a line.
    """
    once = lambda lines, n: lines.groupBy("doc", "key").agg(F.count("*").alias("k"), F.min("line_no").alias(n)).filter("k = 1").drop("k")
    pairs = once(a, "line_a").join(once(b, "line_b"), ["doc", "key"]).select("doc", "line_a", "line_b")

    def kept(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("line_a")
        return part.iloc[longest_increasing(part["line_b"].to_numpy())]

    return pairs.groupBy("doc").applyInPandas(kept, pairs.schema)


def _keyed(lines: DataFrame) -> DataFrame:
    """Lines with the MD5 of their text, which stands for it."""
    return lines.filter("doc is not null and text is not null").select("doc", F.col("line_no").cast("long").alias("line_no"), F.unhex(F.md5("text")).alias("key"))


def _first_difference(a: DataFrame, b: DataFrame, at: str) -> DataFrame:
    """(doc, same): how many lines from place 1 on are equal one by one; ``at`` counts them from an end."""
    other = b.select("doc", at, F.col("key").alias("other"))
    met = a.select("doc", at, "key").join(other, ["doc", at], "full_outer")
    differs = F.col("key").isNull() | F.col("other").isNull() | (F.col("key") != F.col("other"))
    return met.groupBy("doc").agg((F.coalesce(F.min(F.when(differs, F.col(at))), F.max(at) + 1) - 1).alias("same"))


def aligned_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, verdict, line_a, line_b): lines of two versions of documents, ``equal``, ``deleted`` (only in a) or
    ``inserted`` (only in b). ``a``, ``b``: (doc, line_no, text), line_no from 1 without gaps.

    First the equal lines at both ends of a document are taken off. In what is left, anchors are the lines that
    stand once in each version, in their longest common order; from each anchor lines go together as long as they
    are equal. Repeated lines are so paired along their neighbours. A document of one version only is all deleted
    or inserted. Null documents and null texts are compared with nothing.
    """
    a, b = written(_keyed(a), "lines-a"), written(_keyed(b), "lines-b")
    size = lambda lines, n: lines.groupBy("doc").agg(F.max("line_no").alias(n))
    sizes = written(size(a, "n_a").join(size(b, "n_b"), "doc", "full_outer").fillna(0, ["n_a", "n_b"]), "line-counts")
    placed = lambda lines, n: lines.join(sizes.select("doc", n), "doc").withColumn("from_end", F.col(n) - F.col("line_no") + 1)
    head = _first_difference(a, b, "line_no").withColumnRenamed("same", "head")
    tail = _first_difference(placed(a, "n_a"), placed(b, "n_b"), "from_end").withColumnRenamed("same", "tail")
    ends = sizes.join(head, "doc").join(tail, "doc")
    ends = written(ends.withColumn("tail", F.least("tail", F.least("n_a", "n_b") - F.col("head"))), "line-ends")
    outer = a.join(ends, "doc").filter((F.col("line_no") <= F.col("head")) | (F.col("line_no") > F.col("n_a") - F.col("tail")))
    equal = outer.select("doc", F.lit("equal").alias("verdict"), F.col("line_no").alias("line_a"), F.when(F.col("line_no") <= F.col("head"), F.col("line_no")).otherwise(F.col("line_no") - F.col("n_a") + F.col("n_b")).alias("line_b"))
    core = lambda lines, n: lines.join(ends, "doc").filter((F.col("line_no") > F.col("head")) & (F.col("line_no") <= F.col(n) - F.col("tail"))).select("doc", (F.col("line_no") - F.col("head")).alias("line_no"), "key")
    inner = _aligned_core(written(core(a, "n_a"), "core-a"), written(core(b, "n_b"), "core-b"))
    moved = inner.join(ends.select("doc", "head"), "doc").select("doc", "verdict", (F.col("line_a") + F.col("head")).alias("line_a"), (F.col("line_b") + F.col("head")).alias("line_b"))
    return equal.unionByName(moved)


def _aligned_core(a: DataFrame, b: DataFrame) -> DataFrame:
    """``aligned_lines`` of (doc, line_no, key) without the equal ends."""
    size = lambda lines, n: lines.groupBy("doc").agg(F.max("line_no").alias(n))
    edge = lambda x, y: F.struct(x.cast("long").alias("line_a"), y.cast("long").alias("line_b"))
    ends = size(a, "n_a").join(size(b, "n_b"), "doc").select("doc", F.explode(F.array(edge(F.lit(0), F.lit(0)), edge(F.col("n_a") + 1, F.col("n_b") + 1))).alias("e")).select("doc", "e.*")
    fixed = anchors(a, b).unionByName(ends)
    marked = a.join(fixed.withColumnRenamed("line_a", "line_no").withColumnRenamed("line_b", "fixed_b"), ["doc", "line_no"], "full_outer")
    back = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("doc").orderBy(F.col("line_no").desc()).rowsBetween(Window.unboundedPreceding, 0)
    shift = F.when(F.col("fixed_b").isNotNull(), F.col("fixed_b") - F.col("line_no"))
    carried = {"down": F.last(shift, ignorenulls=True).over(back), "up": F.last(shift, ignorenulls=True).over(ahead), "low_b": F.last("fixed_b", ignorenulls=True).over(back), "high_b": F.last("fixed_b", ignorenulls=True).over(ahead)}
    placed = marked.withColumns(carried).filter("key is not null")
    # the line of b on the way down from the anchor above, and on the way up from the anchor below
    other = lambda c: b.select("doc", F.col("line_no").alias(f"at_{c}"), F.col("key").alias(f"key_{c}"))
    tried = placed.withColumns({f"at_{c}": F.col("line_no") + F.col(c) for c in ("down", "up")})
    for c in ("down", "up"):
        inside = (F.col(f"at_{c}") >= F.col("low_b")) & (F.col(f"at_{c}") <= F.col("high_b"))
        tried = tried.join(other(c), ["doc", f"at_{c}"], "left").withColumn(f"same_{c}", F.coalesce((F.col("key") == F.col(f"key_{c}")) & inside, F.lit(False)))
    # a run from an anchor ends at the first line that differs
    gap = Window.partitionBy("doc", "low_b", "high_b")
    so_far = lambda c, order: F.min(F.col(c).cast("int")).over(gap.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) == 1
    chosen = tried.withColumns({"goes_down": so_far("same_down", F.col("line_no")), "goes_up": so_far("same_up", F.col("line_no").desc())})
    pair = F.when(F.col("fixed_b").isNotNull(), F.col("fixed_b")).when(F.col("goes_down"), F.col("at_down")).when(F.col("goes_up"), F.col("at_up"))
    named = chosen.select("doc", F.col("line_no").alias("line_a"), pair.alias("line_b"), "goes_down")
    # where the runs from above and below want one line of b, the one from above has it
    rank = F.row_number().over(Window.partitionBy("doc", "line_b").orderBy(F.col("goes_down").desc(), "line_a"))
    paired = named.filter("line_b is not null").withColumn("rank", rank).filter("rank = 1").select("doc", "line_a", "line_b")
    paired = written(paired, "line-pairs")
    deleted = a.withColumnRenamed("line_no", "line_a").join(paired, ["doc", "line_a"], "left_anti").select("doc", F.lit("deleted").alias("verdict"), "line_a", F.lit(None).cast("long").alias("line_b"))
    inserted = b.withColumnRenamed("line_no", "line_b").join(paired, ["doc", "line_b"], "left_anti").select("doc", F.lit("inserted").alias("verdict"), F.lit(None).cast("long").alias("line_a"), "line_b")
    return paired.select("doc", F.lit("equal").alias("verdict"), "line_a", "line_b").unionByName(deleted).unionByName(inserted)
