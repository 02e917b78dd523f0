import os

import pytest

import corpus_pipeline
from effectsmith.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages_keep_the_columns_and_only_remove(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and after <= before, name
        before = after
    whole = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == before


def test_run_equals_a_brute_force_version(spark):
    from tokenizers import Tokenizer

    from effectsmith.llm import langid, simhash, toxicity
    from effectsmith.llm.tables import fold
    from tests.llm.test_native_operators import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grammar = toxicity.learned(docs, spark.read.parquet(f"{SF}/labels.parquet"), usable=~fold("doc_id", 4, 2))
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    calm = {i for i, t in rows.items() if grammar.score(t) < 0.3}
    field = langid.learned(docs.filter(docs["doc_id"].isin(sorted(calm))), usable=~fold("doc_id", 5, 0))
    ids = sorted(calm)
    read = dict(zip(ids, field.predict([rows[i] for i in ids]), strict=True))
    left = {i: rows[i] for i in ids if read[i][0] != "und" and read[i][1] >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    sets = {i: set(simhash.shingle_hashes(simhash.words_of(t)).tolist()) for i, t in left.items()}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(left)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = {i: t for i, t in left.items() if find(i) == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute(list(left.items()), items)}
    library = Tokenizer.from_file(corpus_pipeline.WORD_BPE)
    expected = {i: " ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for i, t in left.items() if i not in leaked}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()} == expected


ODD = "doc_id long, text string, lang string, source string, n_chars long, component_id int, h binary"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and clashing names."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from all the other animals of the wood"
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, prose, "en", "a", 1, 1, None), (1, prose, "en", "a", 1, 1, None), (1, prose + " " + item, "en", "b", 2, None, b"x"), (2, prose.upper(), None, None, None, None, None),
        (None, prose, "en", None, None, None, None), (None, prose + " " + item, "en", None, None, None, None), (3, None, "en", "a", 0, None, None), (4, "", "en", "a", 0, None, None),
        (5, "!!! 123", "en", "a", 7, None, None), (6, (prose + " ") * 5000, "en", "a", 7, None, None), (7, "der die das und nicht ist ein eine mit von zu den auf " * 4, "de", "a", 7, None, None),
        (8, "wholly other words stand in this text of number eight and it is fine as it is here", "en", "a", 7, None, None),
    ]
    return spark.createDataFrame(rows, ODD), item


def odd_tables(spark, tmp_path, item):
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_on_odd_tables(spark, tmp_path):
    docs, item = odd_documents(spark)
    sf = odd_tables(spark, tmp_path, item)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda frame: sorted((r["doc_id"] for r in frame.collect()), key=str)
    whole = ids(docs)
    assert ids(stages["toxicity"](spark, docs, sf)) == whole  # nothing to learn, no fixed word
    kept = stages["language"](spark, docs, sf)
    assert kept.columns == docs.columns and set(ids(kept)) == {1, 2, 6, 7, 8, None} and len(ids(kept)) == len(whole) - 3
    one = stages["near duplicates"](spark, docs, sf)
    assert one.columns == docs.columns
    # 1 with prose once (2 is its copy, and 6 has 16 of 20 runs in common), 1 with the item's text, both null ids, one wordless of 3 and 4, the rest
    assert ids(one) == sorted([1, 1, 3, 5, 7, 8, None, None], key=str)
    clean = stages["decontamination"](spark, docs, sf)
    assert len(ids(clean)) == len(whole) - 2 and all(item not in (r["text"] or "") for r in clean.collect())
    assert ids(stages["encoding"](spark, docs, sf)) == whole


def test_language_stage_goes_by_the_field(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["language"]
    scores = {r["doc_id"]: r["score"] for r in registry.QUERIES["op1_language_crf"](spark, SF).collect()}
    least = sorted(scores.values())[20]
    monkeypatch.setattr(corpus_pipeline, "MIN_LANGUAGE_SCORE", least)
    assert {r["doc_id"] for r in stage(spark, docs, SF).collect()} == {i for i, s in scores.items() if s >= least}


def test_stages_on_empty_tables(spark, tmp_path):
    docs, item = odd_documents(spark)
    sf = odd_tables(spark, tmp_path, item)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_every_number_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES if k != "pipeline") == list(range(1, 14))


def test_whole_tables_give_whole_results(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_language_crf", "op3_toxicity", "op6_lm_score", "op9_simhash"):
        assert registry.QUERIES[name](spark, SF).count() == n


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    import glob

    import duckdb

    from tests.test_registry import rows_of

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows_of(registry.QUERIES[name](spark, SF).toPandas()) == rows_of(con.execute(registry.ORACLES[name]).df())


def test_near_duplicates_come_from_fingerprints_first(spark, monkeypatch):
    from effectsmith.llm import simhash

    docs, _ = odd_documents(spark)
    seen = []
    pairs, keys = simhash.fingerprint_pairs, simhash.set_keys
    monkeypatch.setattr(simhash, "fingerprint_pairs", lambda sets: seen.append(pairs(sets)) or seen[-1])
    monkeypatch.setattr(simhash, "set_keys", lambda rows, s: keys(rows, s).limit(0))  # without the join on runs
    long = " ".join(f"word{k}" for k in range(400))
    other = next(t for t in (f"{long} more{k}" for k in range(100)) if bin(simhash.fingerprint(t) ^ simhash.fingerprint(long)).count("1") in (1, 2))
    docs = docs.limit(0).unionByName(spark.createDataFrame([(1, long, None, None, 0, None, None), (2, other, None, None, 0, None, None), (3, "wholly other words", None, None, 0, None, None)], ODD))
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()} == {1, 3}
    assert len(seen) == 1 and seen[0].count() == 1
