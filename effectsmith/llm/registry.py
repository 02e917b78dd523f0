"""The queries of this subpackage and the pipeline, with SQL where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from effectsmith.llm import align, bpe, decontaminate, html_text, langid, lm, pii, quality, repair, simhash, tool_calls, toxicity, url_rules
from effectsmith.llm.oracles import ORACLES
from effectsmith.llm.tables import fold, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learned(docs, usable=~fold("doc_id", 5, 0))
    return langid.labelled(docs, model).select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "n_switches", "second_lang", "second_share")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"), usable=~fold("doc_id", 4, 2))
    return toxicity.scored(docs, model).select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_turns(table(spark, sf_dir, "conversations"))
    return tool_calls.linked(calls, results, tool_calls.chat_schemas(spark)).select(
        "conv_id", "call_id", "name", "level", "status", "valid", "n_calls", "n_results", "json"
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lm.scored(docs, docs.filter(~fold("doc_id", 5, 1)))
    return found.select("doc_id", fold("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.withColumns({f"{rule}_rate": F.round(f"{rule}_rate", 6) for rule in quality.RULES})


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(docs, pii.learned(docs))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_language_crf": op1_language_crf,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_tool_calls": op4_tool_calls,
    "op5_bpe": op5_bpe,
    "op6_lm_score": op6_lm_score,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_rules": op8_url_rules,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_token_alignment": op11_token_alignment,
    "op12_personal_data": op12_personal_data,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}
__all__ = ["ORACLES", "QUERIES"]
