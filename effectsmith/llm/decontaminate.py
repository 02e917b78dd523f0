"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A document is contaminated by an item when at least ``threshold`` of the item's distinct shingles (five
words, letters and digits only, lower case) stand in it. Items are partitioned by their number of
shingles n, in steps of powers of two. In a partition each item keeps the n - ceil(threshold * n) + 1
shingles of least hash, a bottom-k MinHash sketch, and the partition has a least number of shingles that
a document must hold for any of its items: a text that holds threshold * n shingles misses fewer than the
sketch has, so it holds one of them, and a text with fewer than the partition's least is not looked up
in it. So looking up every shingle hash of a document in the sketches' index, (words in a shingle, hash)
in the partitions its own size admits, finds every contaminated document, however long it is, and few
others. Candidates are then verified by the distinct item shingles they hold, as text.

Documents are read, cut into words and exploded once for all shingle sizes in the search, and the few
candidates once more. The sketches are broadcast when they count at most BROADCAST_ROWS (counted first);
beyond that the same join is left to the planner. Documents never meet each other and nothing is gathered
by key but counts, so a passage that many documents share makes one row per document.

Defined results: items with fewer than five words are one shingle of all their words (a one-word item
names every document with the word, one row each); null or wordless items match nothing; null texts hold
nothing; repeated rows are looked up each and named once, with what they hold together; rows
without doc_id cannot be named in a result, ``clean`` judges them by their text; at exactly ``threshold``
an item counts; empty tables give an empty result. Only id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written

SHINGLE = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 1_000_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingled(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """One row for each run of ``words`` of each of these sizes: the other columns, ``size``, ``parts`` (the
    words, null behind the size) and ``hash``.

    The words shifted by 0, 1, ... places are zipped and exploded once; rows that run over the end hold
    nulls. All of it stays in generated code.
    """
    keep = [c for c in rows.columns if c != "words"]
    most = max(sizes)
    # shifts of one length, so that the zipped array is as long as the text; places behind its end are null
    shifted = [F.slice("words", i + 1, F.size("words")).alias(f"w{i}") for i in range(most)]
    each = rows.filter(F.size("words") >= min(sizes)).select(*keep, F.inline(F.arrays_zip(*shifted)))
    cut = lambda size: F.struct(F.lit(size).alias("size"), *[(F.col(f"w{i}") if i < size else F.lit(None).cast("string")).alias(f"w{i}") for i in range(most)])
    if len(sizes) > 1:
        each = each.select(*keep, F.inline(F.array(*[cut(size) for size in sizes])))
    else:
        each = each.withColumn("size", F.lit(most))
    last = F.coalesce(*[F.when(F.col("size") == size, F.col(f"w{size - 1}")) for size in sizes])
    words = [F.col(f"w{i}") for i in range(most)]
    return each.filter(last.isNotNull()).select(*keep, "size", F.array(*words).alias("parts"), F.xxhash64("size", *words).alias("hash"))


def item_shingles(items: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """(item_id, n, k, least, place, hash, shingle, size): distinct shingles of each item by ascending hash.

    ``size``: words in a shingle; ``n``: shingles of the item; ``k``: length of its sketch; ``least``: of
    the item's partition, shingles that a document must hold at least.
    """
    read = items.select(F.col(id_col).alias("item_id"), words_of(F.col("text")).alias("words")).filter("size(words) > 0")
    own = F.least(F.size("words"), F.lit(SHINGLE))
    every = shingled(read.withColumn("own", own), list(range(1, SHINGLE + 1))).filter("size = own")
    every = every.select("item_id", "size", F.concat_ws(" ", "parts").alias("shingle"), "hash").distinct()
    # an item is a short text: its own shingles are one bounded group
    listed = every.groupBy("item_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("hash", "shingle", "size"))).alias("all")
    )
    k = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    least = F.ceil(F.lit(threshold) * F.pow(2.0, F.floor(F.log2("n") + 1e-9)) - 1e-9)
    return listed.select("item_id", "n", k.alias("k"), least.alias("least"), F.posexplode("all").alias("place", "one")).select(
        "item_id", "n", "k", "least", "place", "one.*"
    )


def contaminated(
    docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, item_id, shared, n): every verified pair of a document and an item it contains."""
    known = written(item_shingles(items, item_col, threshold), "benchmark-shingles")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # 1 to 5
    read = docs.select(F.col(doc_col).alias("doc_id"), words_of(F.col("text")).alias("words")).filter("doc_id is not null")
    if not sizes:
        kinds = [f"{c} {t}" for c, t in (read.select("doc_id").dtypes[0], known.select("item_id").dtypes[0])]
        return docs.sparkSession.createDataFrame([], ", ".join([*kinds, "shared long", "n long"]))
    side = F.broadcast if known.count() <= BROADCAST_ROWS else lambda df: df
    sketch = known.filter("place < k").groupBy("hash").agg(F.min("least").alias("least"))
    # a document of m words has m - size + 1 shingles of a size at most
    looked = shingled(read.withColumn("m", F.size("words")), sizes).join(side(sketch), "hash").filter("m - size + 1 >= least")
    candidates = written(looked.select("doc_id").distinct(), "benchmark-candidates")
    wanted = known.select("hash", F.col("shingle").alias("of_item"), "item_id", "place", "n")
    met = shingled(read.join(candidates, "doc_id", "left_semi"), sizes).join(side(wanted), "hash").filter(F.concat_ws(" ", "parts") == F.col("of_item"))
    counted = met.select("doc_id", "item_id", "n", "place").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    return counted.filter(F.col("shared") >= F.ceil(F.lit(threshold) * F.col("n") - 1e-9))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, whose text contains no item: rows are judged by the digest of their
    text, so a null or repeated doc_id is no matter, and copies of a text are judged once."""
    texts = docs.select(F.md5("text").alias("digest"), "text").filter("text is not null")
    leaks = contaminated(texts, items, "digest", threshold=threshold).select("doc_id").distinct()
    leaks = written(leaks.withColumnRenamed("doc_id", "digest_of_leak"), "leaks")
    return docs.join(leaks, F.md5("text") == F.col("digest_of_leak"), "left_anti").select(*docs.columns)
