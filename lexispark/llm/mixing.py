"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tucked, untucked, words


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed and the id: 32 bits of an MD5, so that every rerun agrees."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(sized: DataFrame, source_col: str = "source", weights=(5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) for rows with a source and a size.

    Sources in order of code point, null last, take the weights in turn. The targets sum to `share` of all
    sizes; none is above `limit` times its source's size, and what is above goes to the others by weight.

    That is a water level x with target = least(limit * size, x * weight). With the sources sorted by the
    level at which they are full, the level after the first k are full is (total - their limits) / (weight of
    the others); it rises while the next source is overfull and falls after, so that x is its largest value.
    The windows run over one row per source, in one task: sources are the few parts of a mix, not hosts or authors.
    """
    sources = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    full = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * limit)
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    others = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = full.withColumn("level", left / others).withColumn("level", F.max("level").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return level.select("source", "source_size", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, used: dict[str, str], seed: int, **how) -> DataFrame:
    """Adds size, source_size, target and copies to rows (id, text, source, row)."""
    sized = tucked(docs, **used).withColumn("size", F.size(words(F.col("text"))).cast("bigint"))
    per_source = targets(sized, **how).withColumnRenamed("source", "of_source")
    joined = sized.join(per_source, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return joined.withColumn("copies", F.floor(rate) + (draw(F.col("id"), seed) < rate - F.floor(rate)).cast("bigint"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """docs with size (words), source_size, target (of its source) and copies: how often the mix takes it; columns of
    these names are replaced, all others pass through.

    The rate of a source is target / source_size; a document is taken floor(rate) times, and once more if its
    draw is below the rest. Null texts have size 0; a null source is a source of its own; a source without
    words has target 0. Repeated rows have equal draws. An empty table gives no rows.
    """
    used, made = {"id": id_col, "text": text_col, "source": source_col}, ("size", "source_size", "target", "copies")
    return mixed(docs, used, seed, **how).select(*untucked([c for c in docs.columns if c not in made], **used), *made)


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs, whatever their names."""
    used = {"id": id_col, "text": text_col, "source": source_col}
    taken = mixed(docs, used, seed, **how).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*untucked(docs.columns, **used))


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sized GROUP BY source),
weighted AS (SELECT *, [5.0, 2.0, 1.0][turn % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighted WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM levels),
rated AS (SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
    FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    (size * (floor(rate) + (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate))::INT))::BIGINT AS taken
FROM rated
"""
