"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

A stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from effectsmith.functions.lineage import written
from effectsmith.functions.shipping import shipped
from effectsmith.llm import bpe, decontaminate, langid, simhash, toxicity
from effectsmith.llm.tables import fold, table, texts_kept

#: Least mean probability of a document's language; one over the number of languages is chance.
MIN_LANGUAGE_SCORE = 0.35
#: Rows of an Arrow batch: long texts of many rows at once would fill the Python workers.
BATCH_ROWS = 1000
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def ready(spark: SparkSession) -> SparkSession:
    """The session with the package shipped to its workers and Arrow batches of BATCH_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return shipped(spark)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the grammar does not call toxic.

    A null doc_id is judged like any, by its text; null and empty texts match nothing and stay; repeated
    rows stay as often as they stand; an empty table gives an empty one.
    """
    ready(spark)
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"), usable=~fold("doc_id", 4, 2))
    shared = spark.sparkContext.broadcast(model)  # at most 200 * NEED patterns
    return texts_kept(docs, lambda texts: [shared.value.score(t) < toxicity.THRESHOLD for t in texts])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language: those whose best language has a mean probability of at least
    MIN_LANGUAGE_SCORE by the field. Null texts and texts without letters have none and go; without rows to
    learn from nothing has a language, so all rows go; repeated rows and null ids are judged by their text.
    """
    ready(spark)
    model = langid.learned(docs, usable=~fold("doc_id", 5, 0))
    shared = spark.sparkContext.broadcast(model)  # weights of a fixed number of buckets
    return texts_kept(docs, lambda texts: [lang != langid.UNKNOWN and score >= MIN_LANGUAGE_SCORE for lang, score in shared.value.predict(texts)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact and near copies (five-word runs, similarity 0.8): the one
    with the least doc_id, once. Null, empty and wordless texts are copies of each other; rows of one doc_id
    with different texts are different documents; rows without doc_id cannot be named, and all of them stay.
    """
    ready(spark)
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that contain no benchmark item, judged by their texts: null ids are judged like
    any, null and empty texts hold nothing and stay, repeated rows stay or go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of what is left, as blank-joined text, with the number of ids; one row for each
    row, null texts as empty ones."""
    ready(spark)
    return bpe.encoded(docs, WORD_BPE)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Learned models and SimHash are beyond SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
