"""URL filter by association rules: FP-growth over URL tokens, matched by an inverted index.

Explicit host/path rules give a verdict where one fits. Their verdicts (or a label column of the
caller) label URLs; FP-growth mines token combinations that go with a label; rules that pass the
support and confidence bounds judge all other URLs. A rule is dropped when one with a token less says
the same at no less confidence: it could never decide. A rule is found through its tokens: the URL's
tokens are joined with (token, rule) pairs, and a rule fits when all of its tokens were met.

Every label, path segment and query key of a URL is a token. Tokens are counted first: those below the support
are in no rule, and those that stand in exactly the same labelled URLs are one item, since any of them says what
the others say; a URL holds an item when it holds one of its tokens. So a long URL that a third of all pages share
is one item and not a combination of hundreds, and no token is left out.

Work is done on distinct token sets, so a host with a third of all pages is matched once per set. Sets
that hold more than 1 / HOT_SETS of all rows (fewer than HOT_SETS, so they are broadcast) get their verdict
where the rows lie; only the other sets are joined by a shuffle.

Defined results: a null URL, or one without ``://``, has empty host and path and no tokens and gets
the default verdict; repeated rows stay repeated; an empty table gives an empty result; columns other
than the id and the URL are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.7
HOT_SETS = 256
DEFAULT = "allow"
MARK = "label="


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path; null if none does."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        domain, _, prefix = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: all host labels, path segments with digit runs as ``#``, and query keys."""

    def listed(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    segments = F.split(F.regexp_replace(F.lower(path), r"\d+", "#"), "/")
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    every = F.concat(listed("host:", F.split(host, r"\.")), listed("path:", segments), listed("query:", keys))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def items_of(sets: DataFrame, min_support: float) -> DataFrame:
    """(token, item) of the tokens that reach the support among labelled URLs: the least token of all that stand in the
    same labelled sets. ``sets``: (set_id, tokens, labelled), one row a set, with its number of labelled URLs.

    Tokens are the same when their sets' hashes have the same sum and the same xor (128 bits).
    """
    known = sets.filter("labelled > 0")
    least = math.ceil((known.agg(F.sum("labelled")).first()[0] or 0) * min_support)
    each = known.select("labelled", F.explode("tokens").alias("token"), F.xxhash64("set_id", F.lit(1)).cast("decimal(38,0)").alias("h"), F.xxhash64("set_id", F.lit(2)).alias("g"))
    counted = each.groupBy("token").agg(F.sum("labelled").alias("n"), F.sum("h").alias("h"), F.bit_xor("g").alias("g"))
    often = written(counted.filter(F.col("n") >= max(1, least)), "url-often")
    names = often.groupBy("n", "h", "g").agg(F.min("token").alias("item"))
    return often.join(names, ["n", "h", "g"]).select("token", "item")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, antecedent, verdict, confidence, support) from rows (items, label)."""
    items = labelled.select(F.concat("items", F.array(F.concat(F.lit(MARK), F.col("label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.filter(
        F.element_at("consequent", 1).startswith(MARK) & ~F.exists("antecedent", lambda x: x.startswith(MARK))
    )
    rules = rules.select(
        F.xxhash64(F.array_sort("antecedent"), "consequent").alias("rule_id"),
        F.array_sort("antecedent").alias("antecedent"),
        F.substr(F.element_at("consequent", 1), F.lit(len(MARK) + 1)).alias("verdict"),
        "confidence",
        "support",
    )
    rules = written(rules, "url-rules-mined")
    # rules with one token more, by what is left without it
    longer = rules.filter(F.size("antecedent") > 1).select("rule_id", "verdict", "confidence", F.explode("antecedent").alias("token"), "antecedent")
    longer = longer.select("rule_id", "verdict", "confidence", F.array_remove("antecedent", F.col("token")).alias("antecedent"))
    shorter = rules.select("antecedent", "verdict", F.col("confidence").alias("of_shorter"))
    idle = longer.join(shorter, ["antecedent", "verdict"]).filter("of_shorter >= confidence").select("rule_id").distinct()
    return rules.join(idle, "rule_id", "left_anti")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule of each set of items: most confident, then best supported, then longest.

    ``sets``: (set_id, items), one row a set. Both sides are joined by token without a hint: adaptive
    execution broadcasts the index only when its measured size is under the session's threshold.
    """
    index = rules.select(
        F.explode("antecedent").alias("token"), "rule_id", "verdict", "confidence", "support", F.size("antecedent").alias("n")
    )
    met = sets.select("set_id", F.explode("items").alias("token")).join(index, "token")
    whole = met.groupBy("set_id", "rule_id").agg(
        F.count("*").alias("met"),
        F.first("n").alias("n"),
        F.first(F.struct("confidence", "support", "n", "verdict", "rule_id")).alias("rule"),
    )
    return whole.filter("met = n").groupBy("set_id").agg(F.max("rule").alias("best"))


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    label_col: str | None = None,
    rules=RULES,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    default: str = DEFAULT,
) -> DataFrame:
    """Host, path, explicit rule and verdict of every URL; ``mined`` holds what the mined rules say.

    ``label_col``: a column with labels to learn from; without it the explicit rules' verdicts are.
    """
    named = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(label_col).alias("given") if label_col else F.lit(None).cast("string").alias("given"),
    )
    parts = named.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = parts.withColumn("fit", explicit_rule(F.col("host"), F.col("path"), rules))
    seen = ruled.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.col("fit.verdict").alias("by_rule"),
        F.coalesce("given", "fit.verdict").alias("label"),
        tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"),
    ).withColumn("set_id", F.xxhash64("tokens"))
    seen = written(seen, "url-tokens")
    sets = seen.groupBy("set_id").agg(F.first("tokens").alias("tokens"), F.count_if(F.col("rule").isNull()).alias("n"), F.count("label").alias("labelled"))
    sets = written(sets.filter("size(tokens) > 0"), "url-sets")
    items = written(items_of(sets, min_support), "url-items")
    held = sets.select("set_id", F.explode("tokens").alias("token")).join(items, "token").groupBy("set_id").agg(F.collect_set("item").alias("items"))
    held = written(held, "url-set-items")
    # a labelled URL without any such token still counts for the support
    learned = seen.filter("label is not null and size(tokens) > 0").select("set_id", "label").join(held, "set_id", "left")
    mined = written(mine(learned.select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "label"), min_support, min_confidence), "url-rules")
    judged = sets.filter("n > 0").select("set_id", "n")
    best = written(judged.join(match(held.join(judged, "set_id", "left_semi"), mined), "set_id", "left"), "url-best")
    hot = best.filter(F.col("n") > seen.count() / HOT_SETS).select("set_id", F.struct("best").alias("hot"))
    by_set = seen.withColumn("set_id", F.when(F.col("rule").isNull(), F.col("set_id"))).join(F.broadcast(hot), "set_id", "left")
    others = by_set.filter("rule is null and hot is null").join(best.select("set_id", "best"), "set_id", "left")
    ready = by_set.filter("rule is not null or hot is not null").withColumn("best", F.col("hot.best"))
    return others.unionByName(ready).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", "best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.verdict").alias("mined"),
        F.col("best.confidence").alias("confidence"),
    )
