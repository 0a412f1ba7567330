"""The corpus pipeline over the table documents: quality rules, line dedup, SimHash near-dedup, mixing to target
weights, SentencePiece encoding. Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import lines, mixing, passages, quality, sentencepiece, simhash
from lexispark.llm.common import WORD, Tables, filter_after, tucked, untucked
from lexispark.llm.queries import MODEL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts go; repeated rows are judged each; an empty table stays empty."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of 50 words or more that stand earlier, first whole lines of them, then passages within lines;
    documents of which nothing is left go. n_chars follows the text. Null and empty texts stay; repeated rows are one
    document and stay; rows of one id (null too) and different texts are documents of their own; an empty table stays empty."""
    own, found = docs.columns, lines.dedup(tucked(docs, doc_id="doc_id", text="text"))
    out = filter_after(found, ~((F.col("cut_lines") > 0) & (F.trim("text") == ""))).select("doc_id", "text", "row")
    found = passages.dedup(Tables(spark).keep(out))
    out = filter_after(found, (F.col("cut_words") == 0) | F.col("text").rlike(WORD))
    out = out.select(*untucked(own, doc_id="doc_id", text="text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in own else out


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, a similarity of 0.8 or more. Null texts, empty
    ones and those without words are one group; of repeated rows one stays; null ids and repeated ids with different texts
    stand for documents of their own; an empty table stays empty."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. A null source is one more source; documents without words count nothing
    and are taken at the rate of their source; repeated rows and null ids share a draw; an empty table stays empty."""
    return mixing.emit(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_ids, ids) of each document of the mix; no ids for null and empty texts."""
    encoded = sentencepiece.encode(docs.select("doc_id", "source", "text"), sentencepiece.read_model(spark, MODEL))
    return encoded.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_ids"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece_encoding", sentencepiece_encoding),
]
#: SimHash groups and SentencePiece ids are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written to the shared folder and read again."""
    tables, docs = Tables(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = tables.keep(docs)
    return docs
