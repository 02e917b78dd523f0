"""Host-level quality rules: failures by domain, shrunk by an empirical beta prior.

Per text: words, characters in words, symbols, repeated lines and words in repeated three-word windows.
They give four rules. ``few`` and ``repeats`` (the base) fail a document by themselves; ``symbols`` and
``lines`` are soft: one alone may be a table or a poem, so the host decides. Per host (the domain, here
``source``) and rule, failures are counted, partial counts first, so a host with a third of all rows is
one small row per task. For each rule a beta prior fitted by moments over the hosts shrinks the host's
rate. A host is bad in a rule when its shrunk rate, less LEVEL posterior standard deviations, is above
the prior's mean; a document that fails a soft rule goes when its host is bad in that rule. A host with a
shrunk rate above MAX_HOST_RATE in any rule is junk, and all of its documents go.

Defined results: a null text has no words and fails; a null host is a host of its own; repeated rows are
counted and returned as often as they stand; an empty table gives an empty result; columns other than
doc_id, source and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINES = 20
LEVEL = 0.5
MAX_HOST_RATE = 0.5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOL = re.compile(rb"[#*$%&|<>]")
NOT_CODE_POINT_START = bytes(range(0x80, 0xC0))
BLANK_BYTES = b" \t\n\x0b\x0c\r"


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of one text. Words are parted by the ASCII blanks, as bytes.split() parts them."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(raw.translate(None, BLANK_BYTES + NOT_CODE_POINT_START))
    lines = [line for line in raw.split(b"\n") if line.strip(BLANK_BYTES)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    inside = 0
    seen = Counter(windows)
    if len(seen) < len(windows):
        hit = bytearray(len(words))
        for at in compress(range(len(windows)), map((1).__lt__, map(seen.__getitem__, windows))):
            hit[at : at + 3] = b"\1\1\1"
        inside = sum(hit)
    return len(words), chars, len(SYMBOL.findall(raw)), len(lines) - len(set(lines)), inside


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_stats(t) for t in batch.column("text").to_pylist()]
        columns = zip(*found, strict=True) if found else repeat((), len(STATS))
        arrays = [batch.column("doc_id"), batch.column("host")] + [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "host", *STATS])


def with_stats(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """(doc_id, host, five counts) of every document; the text stays behind."""
    rows = docs.select("doc_id", F.col(host_col).cast("string").alias("host"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_stats, f"doc_id {kind}, host string, " + ", ".join(f"{c} long" for c in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


RULES = {
    "few": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"n_symbols > {MAX_SYMBOLS_PER_WORD} * n_words",
    "lines": f"n_dup_lines > {MAX_DUP_LINES}",
}
SOFT = ("symbols", "lines")


def host_rates(stats: DataFrame, level: float = LEVEL) -> DataFrame:
    """(host, n, and for each rule <rule>_rate, <rule>_bad): one row a host, rates shrunk.

    For each rule the moments of the hosts' rates, weighted by their documents, give mean m and variance
    v; the prior holds m(1-m)/v - 1 documents (bounded to 1..1e6), so a host with few documents is drawn
    to m.
    """
    hosts = stats.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.expr(failed)).alias(rule) for rule, failed in RULES.items()])
    hosts = written(hosts, "quality-hosts")
    moments = [m for rule in RULES for m in (
        (F.sum(rule) / F.sum("n")).alias(f"{rule}_m"), (F.sum(F.col(rule) * F.col(rule) / F.col("n")) / F.sum("n")).alias(f"{rule}_s"))]
    row = hosts.agg(*moments).first()
    columns = [F.col("host"), F.col("n")]
    for rule in RULES:
        m, s = float(row[f"{rule}_m"] or 0.0), float(row[f"{rule}_s"] or 0.0)
        k = min(max(m * (1 - m) / max(s - m * m, 1e-12) - 1, 1.0), 1e6)
        p = (F.col(rule) + F.lit(m * k)) / (F.col("n") + F.lit(k))
        lower = p - F.lit(level) * F.sqrt(p * (1 - p) / (F.col("n") + F.lit(k + 1)))
        columns += [p.alias(f"{rule}_rate"), (lower > m + 1e-12).alias(f"{rule}_bad")]
    return hosts.select(*columns)


def judged(docs: DataFrame, host_col: str = "source", level: float = LEVEL, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Counts, ``base_failed``, the host's shrunk rates and ``kept`` of every document."""
    stats = written(with_stats(docs, host_col), "quality-stats")
    rates = host_rates(stats, level).drop("n").withColumnRenamed("host", "of_host")
    back = stats.join(rates, F.col("host").eqNullSafe(F.col("of_host")), "left")
    failed = base_failed()
    dropped = failed | (F.greatest(*[f"{r}_rate" for r in RULES]) > max_host_rate)
    for rule in SOFT:
        dropped = dropped | (F.expr(RULES[rule]) & F.col(f"{rule}_bad"))
    return back.select("doc_id", *STATS, failed.alias("base_failed"), *[F.col(f"{r}_rate") for r in RULES], (~dropped).alias("kept"))
