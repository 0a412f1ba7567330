"""A whole matching job as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import SOURCES
from lexispark.operators import annotate, match, names
from lexispark.sources.names import read_names

from .config import MatchConfig


def patterns_for(spark, config: MatchConfig) -> DataFrame:
    if not config.names_path:
        raise ValueError("names_path is not set")
    return names.prepare(read_names(spark, config.names_path, config.names_format), config)


def matched(docs: DataFrame, patterns: DataFrame, config: MatchConfig = MatchConfig(), columns: dict[str, str] | None = None) -> DataFrame:
    """docs with text, content_form, mentions and targets, row by row (batch, or a stream with a small dictionary);
    columns of these names are replaced."""
    texts = match.best_text(docs, config, columns)
    if not match.fits(patterns, config):
        return match.with_mentions_and_targets(texts, patterns, config)
    return annotate.with_targets(match.with_mentions(texts, patterns, config, small=True), patterns, config, True)


def run(docs: DataFrame, patterns: DataFrame, config: MatchConfig = MatchConfig(), columns: dict[str, str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Reads at most max_items documents, finds mentions, annotates, and keeps, drops or blanks. The columns of docs come back as
    they were, but ratings and sentences, which get an entry more."""
    docs = annotate.first_items(docs, config.max_items, id_col) if config.max_items is not None else docs
    sources = {s: c for s, c in (columns or {s: s for s in SOURCES}).items() if c in docs.columns}
    records = ("ratings", "sentences")
    # Own names throughout: the columns of docs are fields of a struct meanwhile.
    apart = docs.select(F.struct("*").alias("row"), *[F.col(c).alias(f"source_{s}") for s, c in sources.items()], *[F.col(c) for c in records if c in docs.columns])
    full = annotate.annotated(matched(apart, patterns, config, {s: f"source_{s}" for s in sources}), config)
    some = F.coalesce(F.size("mentions") > 0, F.lit(False))
    kept = ~some if config.negate else some
    kinds = {**dict(docs.dtypes), **{c: "map" for c in records}}
    out = {c: F.col(c) if c in records else F.col("row").getField(c) for c in dict.fromkeys((*docs.columns, *records))}
    if config.emit_empties:
        return full.withColumn("kept", kept).select(*[annotate.blank(v, kinds[c], F.col("kept")).alias(c) for c, v in out.items()])
    return match.filter_made(full, kept).select(*[v.alias(c) for c, v in out.items()])
