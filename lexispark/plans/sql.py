"""The same functions under names that SQL can call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.normalize import decoded_prefix, normalized
from lexispark.operators.match import collected, finder, fits, listed, matcher

from .config import MatchConfig


def register(spark: SparkSession, patterns: DataFrame | None = None, config: MatchConfig = MatchConfig()) -> None:
    """lexi_normalize(text), lexi_decode(binary) and, with patterns of a small dictionary, lexi_mentions(text), an array of mentions to
    explode, and the table function lexi_find(text) of their surface, pattern and place."""
    spark.udf.register("lexi_normalize", normalized)
    spark.udf.register("lexi_decode", decoded_prefix)
    if patterns is not None:
        if not fits(patterns, config):
            raise ValueError("the dictionary is larger than max_broadcast; join it by match.mentions")
        names = collected(patterns)
        spark.udf.register("lexi_mentions", matcher(names, config.normalize))
        spark.udtf.register("lexi_find", table_function(names, config.normalize))


def table_function(names: list[str], how: str):
    """A table function of a text: one row per mention."""
    find = finder(names, how)

    @F.udtf(returnType="pattern_id int, start_char int, end_char int, value string")
    class Find:
        def eval(self, text: str):
            for m in listed([find(text)], how)[0].as_py():
                yield m["pattern_id"], m["start_char"], m["end_char"], m["value"]

    return Find
