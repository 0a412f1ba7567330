"""The same job on a stream of documents. It holds no state: every step works within a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.plans.config import MatchConfig
from lexispark.plans.job import matched


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder (or a pattern, which may name single files) as they arrive; the number of files a batch takes is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def rated_stream(docs: DataFrame, patterns: DataFrame, config: MatchConfig = MatchConfig(), columns: dict[str, str] | None = None) -> DataFrame:
    """The kept documents with their mentions and targets; the dictionary has to be a small one. The counters of each batch, its
    characters too, are observed under `run`."""
    full = matched(docs, patterns, config, columns)
    some = F.size("mentions") > 0
    full = full.observe("run", F.count(F.lit(1)).alias("processed"), F.count_if(some).alias("matched"), F.sum(F.size("targets")).alias("ratings"), F.sum(F.octet_length("text")).alias("bytes"))
    return full.filter(~some if config.negate else some)


def rates(query) -> list[tuple[int, int, float]]:
    """(batch, documents, documents a second) of the batches that a query remembers."""
    return [(p["batchId"], p["numInputRows"], p["processedRowsPerSecond"]) for p in query.recentProgress]


def write_stream(rated: DataFrame, path: str, checkpoint: str):
    """A query that writes Parquet exactly once and stops when what is there has been read."""
    return rated.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
