"""What mentions say about documents: ratings, records, counters, blanks for documents not kept.

The steps on nested columns work row by row, in batch and in streams alike; only the long forms explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators import match
from lexispark.plans.config import MatchConfig


def ratings(found: DataFrame, patterns: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Distinct (id, target_id)."""
    targets = patterns.select("pattern_id", F.explode("target_ids").alias("target_id")).filter("target_id is not null")
    return found.select(id_col, "pattern_id").distinct().join(targets, "pattern_id").select(id_col, "target_id").distinct()


def with_targets(docs: DataFrame, patterns: DataFrame, config: MatchConfig = MatchConfig(), small: bool | None = None) -> DataFrame:
    """Adds `targets`, the distinct targets of the mentions in byte order, to rows with `mentions`. Row by row: the targets of a small
    dictionary are one literal map; with a larger one, each set of patterns that some row has is joined once. small:
    what fits() says, if it is known."""
    ids = F.transform("mentions", lambda m: m["pattern_id"])
    if match.fits(patterns, config) if small is None else small:
        known = {r["pattern_id"]: sorted(t for t in r["target_ids"] if t is not None) for r in patterns.select("pattern_id", "target_ids").collect()}

        @F.arrow_udf("array<string>")
        def of(ids):
            import pyarrow as pa

            return pa.array([sorted({t for i in row or () for t in known[i]}) for row in ids.to_pylist()], pa.list_(pa.string()))

        return docs.withColumn("targets", of(ids))
    match.refuse_stream(docs)
    rows = docs.drop("targets").select(F.struct("*").alias("row"), F.array_sort(F.array_distinct(ids)).alias("ids"))
    sets = rows.select("ids").distinct().select("ids", F.explode("ids").alias("pattern_id"))
    each = sets.join(patterns.select("pattern_id", "target_ids"), "pattern_id").select("ids", F.explode("target_ids").alias("target_id")).filter("target_id is not null")
    per_set = each.groupBy("ids").agg(F.sort_array(F.collect_set("target_id")).alias("targets"))
    return rows.join(per_set, "ids", "left").select("row.*", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def put(column: Column, key: str, value: Column) -> Column:
    """A map with the entry of a key replaced."""
    return F.map_concat(F.map_filter(column, lambda k, _: k != key), F.create_map(F.lit(key), value))


def ratings_record(targets: Column, annotator_id: str) -> Column:
    """list<Rating{annotator{annotator_id}, target{target_id}}>."""
    annotator = F.struct(F.lit(annotator_id).alias("annotator_id")).alias("annotator")
    return F.transform(targets, lambda t: F.struct(annotator, F.struct(t.alias("target_id")).alias("target")))


def sentences_record(mentions: Column, content_form: Column, normalize: str = "unicode") -> Column:
    """One sentence with a token per mention; BYTES offsets always, CHARS only of normalized text."""

    def offset(kind: str, m: Column) -> Column:
        first, end = (m[f"{side}_{kind}"] for side in ("start", "end"))
        return F.struct(F.lit({"byte": "BYTES", "char": "CHARS"}[kind]).alias("type"), first.alias("first"), (end - first).alias("length"), m["value"].alias("value"), content_form.alias("content_form"))

    def token(m: Column, i: Column) -> Column:
        kinds = ("byte", "char") if normalize != "none" else ("byte",)
        offsets = F.create_map(*[x for k in kinds for x in (F.lit({"byte": "BYTES", "char": "CHARS"}[k]), offset(k, m))])
        return F.struct(i.cast("int").alias("token_num"), m["value"].alias("token"), offsets.alias("offsets"))

    tokens = F.transform(F.coalesce(mentions, F.array().cast(match.MENTIONS)), token)
    return F.array(F.struct(tokens.alias("tokens")))


def annotated(docs: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Adds the maps `ratings` and `sentences` to rows with `mentions`, `targets` and `content_form`. A document
    without targets keeps its ratings; sentences are written for every document that has a text."""
    has = set(docs.columns)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<struct<annotator:struct<annotator_id:string>,target:struct<target_id:string>>>>"))
    ratings = F.col("ratings") if "ratings" in has else empty
    out = docs.withColumn("ratings", F.when(F.size("targets") > 0, put(ratings, config.annotator_id, ratings_record(F.col("targets"), config.annotator_id))).otherwise(ratings))
    sentences = sentences_record(F.col("mentions"), F.col("content_form"), config.normalize)
    record = F.create_map(F.lit(config.annotator_id), sentences)
    return out.withColumn("sentences", F.when(F.col("content_form").isNotNull(), put(F.col("sentences"), config.annotator_id, sentences) if "sentences" in has else record))


def blank(value: Column, kind: str, kept: Column) -> Column:
    return F.when(kept, value).otherwise(F.lit("") if kind == "string" else F.lit(None))


def blank_unmatched(docs: DataFrame, kept: Column) -> DataFrame:
    """Every document; those not kept have '' in every string and null elsewhere."""
    return docs.select(*[blank(F.col(c), kind, kept).alias(c) for c, kind in docs.dtypes])


def summary(docs: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Counters of a run over rows with `mentions` and `targets`, in one aggregation. Empties are not counted as written."""
    some = F.size("mentions") > 0
    kept = ~some if config.negate else some
    return docs.agg(
        F.count("*").alias("processed"),
        F.count_if(some).alias("matched"),
        F.count_if(kept).alias("written"),
        F.coalesce(F.sum(F.size("mentions")), F.lit(0)).cast("bigint").alias("mentions"),
        F.coalesce(F.sum(F.size("targets")), F.lit(0)).cast("bigint").alias("ratings"),
    ).withColumn("ratings_per_written", F.try_divide(F.col("ratings").cast("double"), F.col("written")))


def content_bytes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.agg(F.count(text).alias("n_texts"), F.sum(F.octet_length(text)).cast("bigint").alias("bytes"))


def targets_per_document(rated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return rated.groupBy(id_col).agg(F.countDistinct("target_id").alias("n_targets"))


def first_items(docs: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """The first n documents in order of id, before anything is filtered."""
    return docs.orderBy(id_col).limit(n)
