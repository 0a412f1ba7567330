"""Preparing a dictionary: name_targets(name, target_id) becomes patterns(pattern_id, norm_name, name, target_ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.normalize import normal_form
from lexispark.functions.tokens import SEPARATOR_CLASS, tokenized, tokens
from lexispark.plans.config import MatchConfig


def invert(targets: DataFrame) -> DataFrame:
    """(target_id, names array) to (name, target_ids), targets in byte order, duplicates kept."""
    long = targets.select("target_id", F.explode("names").alias("name"))
    return long.groupBy("name").agg(F.array_sort(F.collect_list("target_id")).alias("target_ids"))


def counts(name_targets: DataFrame) -> DataFrame:
    return name_targets.agg(F.countDistinct("name").alias("n_names"), F.countDistinct("target_id").alias("n_targets"))


def normalize_names(name_targets: DataFrame, how: str = "unicode") -> DataFrame:
    return name_targets.withColumn("norm_name", normal_form(F.col("name"), how))


def within_length(names: DataFrame, low: int = 5, high: int = 1000) -> DataFrame:
    """Both bounds count, in UTF-8 bytes of the normalized name; empty names go."""
    return names.filter(F.octet_length("norm_name").between(max(1, low), high))


def first_names(name_targets: DataFrame, n: int) -> DataFrame:
    """The targets of the first n distinct names in byte order."""
    kept = name_targets.select("name").distinct().orderBy("name").limit(n)
    return name_targets.join(kept, "name", "left_semi")


def without_duplicates(names: DataFrame, policy: str = "first") -> DataFrame:
    """One row per norm_name with the winning name (first by bytes) and its target_ids, or those of all."""
    if policy == "union":
        return names.groupBy("norm_name").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("target_id")).alias("target_ids"))
    # The winner has the smallest name; the minimum comes together before the shuffle.
    per_name = names.groupBy("norm_name", "name").agg(F.array_sort(F.collect_set("target_id")).alias("target_ids"))
    return per_name.groupBy("norm_name").agg(F.min(F.struct("name", "target_ids")).alias("w")).select("norm_name", "w.name", "w.target_ids")


def stats(patterns: DataFrame) -> DataFrame:
    size = F.octet_length("norm_name").cast("bigint")
    return patterns.agg(F.count("*").alias("n_patterns"), F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"), F.sum(size).alias("total_bytes"))


def prepare(name_targets: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """patterns(pattern_id, norm_name, name, target_ids); ids by order of norm_name."""
    named = first_names(name_targets, config.max_names) if config.max_names is not None else name_targets
    kept = within_length(normalize_names(named, config.normalize), config.min_bytes, config.max_bytes)
    return numbered(without_duplicates(kept, config.duplicates))


def numbered(patterns: DataFrame) -> DataFrame:
    """Ids 0, 1, ... by order of norm_name, counted within the names of equal first three characters and over these groups:
    only the counts of the groups meet in one task."""
    grouped = patterns.withColumn("head", F.substring("norm_name", 1, 3))
    sizes = grouped.groupBy("head").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("head", F.coalesce(before, F.lit(0).cast("bigint")).alias("start"))
    row = F.row_number().over(Window.partitionBy("head").orderBy("norm_name")) - 1
    placed = grouped.withColumn("row", row).join(starts, "head")
    return placed.select((F.col("start") + F.col("row")).cast("int").alias("pattern_id"), "norm_name", "name", "target_ids")


def good_tokenized(names: DataFrame) -> DataFrame:
    """Distinct tokenized names of 3 to 1000 bytes with a token or more, and their number of tokens."""
    made = names.select(tokenized(F.col("name")).alias("tokenized"), F.size(tokens(F.col("name"))).cast("bigint").alias("n_tokens"))
    return made.filter(F.octet_length("tokenized").between(3, 1000) & (F.col("n_tokens") >= 1)).dropDuplicates(["tokenized"])


def good_raw(names: DataFrame) -> DataFrame:
    """Names of 3 to 64 bytes with a character that separates nothing."""
    return names.filter(F.octet_length("name").between(3, 64) & (F.regexp_replace("name", SEPARATOR_CLASS, "") != ""))


def token_stats(names: DataFrame) -> DataFrame:
    size = F.octet_length("tokenized").cast("bigint")
    return good_tokenized(names).agg(F.count("*").alias("n_good"), F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"), F.avg(size).alias("avg_bytes"), F.avg("n_tokens").alias("avg_tokens"), F.sum(size).alias("total_bytes"))
