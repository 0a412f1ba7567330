"""The queries of this subpackage and, where SQL can express them, the SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, lines, mixing, quality, sentencepiece, sharding, simhash, toxicity, urls
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.by_text(table(spark, sf_dir, "documents"), shards=40)


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, lanes=1, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


#: A public model of the BPE type with byte fallback; the path is a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op8_sentencepiece(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    model = sentencepiece.read_model(spark, path)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece.encode_checked(docs, model)
    return both.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), "round_trip")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(toxicity.remainder() != 0))
    return toxicity.score(docs, model).select("doc_id", (toxicity.remainder() == 0).alias("held_out"), "score", "predicted")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"))
    return urls.judge(table(spark, sf_dir, "pages"), outcomes)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_tool_call_linking": op2_tool_call_linking,
    "op3_source_mixing": op3_source_mixing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_url_filters": op10_url_filters,
}
ORACLES = {
    "op2_tool_call_linking": chat.ORACLE,
    "op3_source_mixing": mixing.ORACLE,
    "op5_line_dedup": lines.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op10_url_filters": urls.ORACLE,
}
