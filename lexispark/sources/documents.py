"""Reading and writing documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The nested shape of a document, for sinks that want it.
DOCUMENT = (
    "doc_id string, stream_id string, stream_time struct<epoch_ticks:double,zulu_timestamp:string>, "
    "body struct<raw:binary,clean_html:string,clean_visible:string,encoding:string,media_type:string,"
    "sentences:map<string,array<struct<tokens:array<struct<token_num:int,token:string,offsets:map<string,struct<type:string,first:int,length:int,value:string,content_form:string>>>>>>>,"
    "labels:map<string,array<struct<annotator:struct<annotator_id:string>,target:struct<target_id:string>,first:int,length:int>>>>, "
    "ratings map<string,array<struct<annotator:struct<annotator_id:string>,target:struct<target_id:string>>>>"
)


def read_documents(spark: SparkSession, path: str, text: str | None = "text") -> DataFrame:
    """A Parquet table; the column `text`, if given, is named clean_visible."""
    docs = spark.read.parquet(path)
    return docs.withColumnRenamed(text, "clean_visible") if text else docs


def prefix(id_col: Column) -> Column:
    """The folder of a document: its id's first three characters."""
    return F.substring(id_col.cast("string"), 1, 3)


def write_documents(docs: DataFrame, path: str, by_prefix: bool = False, id_col: str = "doc_id") -> None:
    """Parquet; committed as a whole, an old table is replaced. by_prefix: one folder per id prefix, so that a
    lookup by id reads one folder."""
    if by_prefix:
        docs.withColumn("id_prefix", prefix(F.col(id_col))).repartition("id_prefix").write.mode("overwrite").partitionBy("id_prefix").parquet(path)
    else:
        docs.write.mode("overwrite").parquet(path)


def lookup(docs: DataFrame, doc_id: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of an id; a table written by prefix is pruned to one folder."""
    place = F.col("id_prefix").cast("string") == doc_id[:3] if "id_prefix" in docs.columns else prefix(F.col(id_col)) == doc_id[:3]
    return docs.filter(place & (F.col(id_col).cast("string") == doc_id))
