import hashlib
import os
import random
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from effectsmith.functions import lineage
from effectsmith.llm import align
from effectsmith.llm.registry import BYTE_BPE, PIECES, QUERIES

SF = "/root/testdata/sf0.001"


def encoded(own, text):
    """Byte ranges and ids of both sides, from the libraries' own answers on the whole text."""
    if not text:
        return [], []
    raw = (" " + text).encode()
    sides = []
    for ids, table in ((own.a.encode(" " + text, add_special_tokens=False).ids, own.a_bytes), (own.b.encode(text), own.b_bytes)):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in ids) != raw:
            return [], []
        sides.append(out)
    return sides


def brute(own, texts):
    """The contract's columns of every text, by comparing all pairs of tokens."""
    rows, holders = [], Counter()
    for text in texts:
        a, b = encoded(own, text) or ([], [])
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= cut) for side in (a, b)))
            low = cut
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        holders.update(set(links))
        rows.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    return [(n_a, n_b, n_g, len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links), d) for n_a, n_b, n_g, links, d in rows]


def some_texts():
    r = random.Random(3)
    letters = "ab é,.'\"-  \n\tS1×÷ªßǅ&%#:;!?s't ́日▁<|endoftext|>\r᠎ "
    odd = ["".join(r.choice(letters) for _ in range(r.randint(0, 24))) for _ in range(300)]
    return [*odd, "", None, " ", "  ", "\n", "<s> a</s><unk>", "<|endoftext|>", "'s,'t ,,a.b,c", "x" * 400, "same text.", "same text.", "▁", "a\n\n b"]


@pytest.fixture(scope="module")
def own():
    return align.aligner(BYTE_BPE, PIECES)


def test_rows_equal_brute_force(spark, own, monkeypatch):
    texts = some_texts()
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, batch string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in align.aligned(frame, BYTE_BPE, PIECES).collect()}
    expected = brute(own, texts)
    for i, text in enumerate(texts):
        assert got[i] == expected[i], repr(text)


def test_batches_and_cache_change_nothing(own, monkeypatch):
    texts = [t for t in some_texts() if t]
    whole = [t.to_numpy().tolist() for t in own.tokens(texts)]
    monkeypatch.setattr(align, "CACHE_SEGMENTS", 50)
    small = align.Aligner(BYTE_BPE, PIECES)
    parts = [[], []]
    for k in range(0, len(texts), 7):
        for side, t in zip(parts, small.tokens(texts[k : k + 7]), strict=True):
            side += t["id"].tolist()
    assert parts == [[row[1] for row in side] for side in whole]


def test_links_are_overlaps(spark, own):
    texts = ["Das thatble.", None, "éèaux, on"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in align.links(frame, BYTE_BPE, PIECES).collect())
    expected = []
    for n, text in enumerate(texts):
        a, b = encoded(own, text) or ([], [])
        expected += [(n, i, j, x[0], y[0], max(x[1], y[1]), min(x[2], y[2])) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
    assert got == sorted(expected)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b."), (None, "a b."), (1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = align.aligned(frame, BYTE_BPE, PIECES).collect()
    assert len(out) == 3 and sorted(r["n_a"] for r in out)[0] == 0
    full = [r for r in out if r["n_a"]]
    assert full[0] == full[1] and full[0]["count_sum"] == 2 * full[0]["n_links"]
    assert align.aligned(frame.limit(0), BYTE_BPE, PIECES).count() == 0


def test_no_task_holds_the_links_of_many_batches(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lineage, "shared_dir", lambda spark: str(tmp_path))
    rows = align._batch_links
    monkeypatch.setattr(align, "_batch_links", lambda *x: rows(*x).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(99)))).coalesce(1))
    frame = spark.createDataFrame([(1, "one text.")], "doc_id long, text string")
    found = align.aligned(frame, BYTE_BPE, PIECES)  # as if 100 batches were in one file
    files = [pq.ParquetFile(f) for f in tmp_path.rglob("token-links*/*.parquet")]
    groups = [f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert sum(groups) == 100 and max(groups) <= 8  # a reader unfolds a whole group of them
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan  # it keeps the lists of up to 128 batches as objects
    assert [tuple(r)[4:7] for r in found.collect()] == [(3, 3, 300)] * 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_query_equals_brute_force(spark, own):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    texts = [t if len(t) < 2500 else t[:0] for t in docs["text"]]
    long = sum(not t for t in texts)
    expected = brute(own, texts)
    found = QUERIES["op11_token_alignment"](spark, SF).toPandas().set_index("doc_id")
    assert len(found) == len(docs) and long < len(docs) / 2
    for doc_id, text, row in zip(docs["doc_id"], texts, expected, strict=True):
        if text:  # counts of pairs are corpus-wide, so only the document's own figures are comparable here
            got = found.loc[doc_id]
            assert (got["n_a"], got["n_b"], got["n_groups"], got["n_links"], got["groups_sha256"]) == (*row[:4], row[6])


def test_vocabularies_stay_where_they_are():
    assert BYTE_BPE == public_tokenizers.path("byte_bpe_50k.json")
