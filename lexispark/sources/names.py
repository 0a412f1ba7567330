"""Reading and writing dictionaries: lines, JSON in both directions, binary structs, offset arrays, Parquet."""

from __future__ import annotations

from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.plans.scratch import scratch

from .binary import read_csr, read_thrift, write_binary, write_file

LONG = "name string, target_id string"


def read_names(spark: SparkSession, path: str, fmt: str = "json", strip_cr: bool = False) -> DataFrame:
    """name_targets(name, target_id) from a file.

    lines: one name a line, without targets; the last line counts without a line end too; empty lines don't. strip_cr
    takes CR off line ends. json: one object target_id -> names; json_inverse: name -> target_ids. thrift: a binary struct of both maps. csr: a file of
    names one after the other, and beside it their offsets. parquet: a table that write_names has written. A path of
    http: or https: is downloaded by the driver first (one file; not csr or parquet).
    """
    if path.startswith(("http:", "https:")):
        path = downloaded(spark, path)
    if fmt == "lines":
        names = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("name"))
        names = names.withColumn("name", F.regexp_replace("name", "\r$", "")) if strip_cr else names
        return names.filter("name <> ''").withColumn("target_id", F.lit(None).cast("string"))
    if fmt in ("json", "json_inverse"):
        return from_json_maps(spark.read.option("wholetext", True).text(path), fmt == "json_inverse")
    if fmt == "thrift":
        return read_thrift(spark, path)
    if fmt == "csr":
        return read_csr(spark, path)
    if fmt == "parquet":
        return spark.read.schema(LONG).parquet(path)
    raise ValueError(f"unknown names format {fmt!r}")


def downloaded(spark: SparkSession, url: str, most: int = 256 << 20) -> str:
    """The path of a copy in the shared folder."""
    with urlopen(url) as response:
        content = response.read(most + 1)
    if len(content) > most:
        raise ValueError(f"{url} has more than {most} bytes")
    path = f"{scratch(spark)}/names"
    write_file(spark, path, content)
    return path


def from_json_maps(texts: DataFrame, inverse: bool = False) -> DataFrame:
    """name_targets from JSON objects in the column value."""
    key, item = ("name", "target_id") if inverse else ("target_id", "name")
    rows = texts.select(F.from_json("value", "map<string,array<string>>", {"mode": "FAILFAST"}).alias("m")).select(F.explode("m").alias(key, "items"))
    return rows.select(key, F.explode("items").alias(item)).select("name", "target_id")


def write_names(name_targets: DataFrame, path: str, fmt: str = "parquet") -> None:
    """fmt: parquet, or a binary format, thrift or csr."""
    if fmt in ("thrift", "csr"):
        write_binary(name_targets, path, fmt)
        return
    if fmt != "parquet":
        raise ValueError(f"unknown names format {fmt!r}")
    name_targets.select("name", "target_id").write.mode("overwrite").parquet(path)
