"""Where intermediate files go: the folder in spark.checkpoint.dir; only on one machine, where it may be unset, a temporary one."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors share no folder")
        root = tempfile.mkdtemp("-lexispark")
    return f"{root}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written out and read again: it is made once, however often it is read."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
