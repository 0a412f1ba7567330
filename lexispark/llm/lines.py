"""Repeated runs of lines, found by winnowing over line hashes.

Blank lines aside, a span is a stretch of consecutive lines with `least` words or more. A span that starts
later in the corpus than an equal span repeats it; every line of a repeating span is deleted, with the blank
lines between. The corpus is ordered by id (null first), text hash and line.

It is enough to look at spans that lose the threshold if their last line goes (one starting at each line) or
if their first line goes (one ending at each line): in a maximal repeated run, the former cover every line
but those of the last `least` words, extending the run forwards, and the latter every line but those of the
first, extending it backwards.

Winnowing: a span is a window, and its line of smallest hash is its fingerprint. Equal spans have equal fingerprints,
wherever they stand. So only fingerprints and their positions are gathered, and positions are joined on the
fingerprint's hash. Those that meet no other go no further. From the others the lines before and after are taken in,
as far as their spans reach, and compared by the hash of all these lines: what is equal around equal
fingerprints is a match, its first position stays and the later ones are deleted; overlapping matches make a run. A
fingerprint that stands in very many places costs a row for each, not one for each two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, Tables, let, tucked, untucked


def solid(line: Column) -> Column:
    """Whether a line has a word."""
    return F.regexp_replace(line, f"^{GAP}", "") != ""


def fingerprints(docs: DataFrame, least: int) -> DataFrame:
    """(id, th, first, last, mark, at) from rows (id, text, th): the first and last line of the spans of each text, and the hash and
    line of their fingerprints. Repeated rows (equal id and text) give their spans once."""
    lines = docs.filter("text is not null").select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    trimmed = F.regexp_replace("line", f"^{GAP}", "")
    lines = lines.withColumn("n", F.size(F.split(trimmed, f"{GAP}(?!$)")) * (trimmed != "").cast("int")).filter("n > 0")
    lines = lines.select("id", "th", "pos", F.xxhash64("line").alias("h"), F.col("n").cast("bigint").alias("n")).repartition(F.col("id"), F.col("th"))
    once = F.row_number().over(Window.partitionBy("id", "th", "pos").orderBy("h"))
    end = F.sum("n").over(Window.partitionBy("id", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("once", once).filter("once = 1").withColumn("e", end).withColumn("c", F.col("e") - F.col("n"))
    out = []
    for order, low, high in (("c", 0, least - 1), ("e", 1 - least, 0)):
        w = Window.partitionBy("id", "th").orderBy(order).rangeBetween(low, high)
        mark = F.min(F.struct("h", "pos")).over(w)
        span = lines.select("id", "th", F.sum("n").over(w).alias("words"), F.min("pos").over(w).alias("first"), F.max("pos").over(w).alias("last"), mark.alias("mark"))
        out.append(span.filter(F.col("words") >= least).select("id", "th", "first", "last", F.col("mark.h").alias("mark"), F.col("mark.pos").alias("at")))
    return out[0].union(out[1])


def extended(docs: DataFrame, around: DataFrame) -> DataFrame:
    """(id, th, first, last, span): the spans around fingerprints, (id, th, spans) of texts that have any, with the hash of their lines."""
    around = around.select(F.col("id").alias("of_id"), F.col("th").alias("of_th"), "spans")
    texts = docs.join(around.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th")))
    hashes = F.transform(F.split("text", "\n"), lambda line: F.when(solid(line), F.xxhash64(line)))
    between = lambda hs, s: F.filter(F.slice(hs, s["first"] + 1, s["last"] - s["first"] + 1), lambda h: h.isNotNull())
    spans = let(hashes, lambda hs: F.transform("spans", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.xxhash64(between(hs, s)).alias("span"))))
    return texts.select("id", "th", F.explode(spans).alias("s")).select("id", "th", "s.*").distinct()


def repeats(docs: DataFrame, least: int) -> DataFrame:
    """(id, th, cuts): the stretches of lines to delete from each text (id, text, th) that has any, in order."""
    tables = Tables(docs.sparkSession)
    found = tables.keep(fingerprints(docs, least))
    place = F.struct("id", "th", "at")
    met = found.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("mark")
    around = found.join(met, "mark", "left_semi").groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    matches = tables.keep(extended(docs, around))
    start = F.struct("id", "th", "first")
    firsts = matches.groupBy("span").agg(F.min(start).alias("a"), F.max(start).alias("b")).filter("a <> b").select("span", "a")
    later = matches.join(firsts, "span").filter(start != F.col("a")).select("id", "th", "first", "last").distinct()
    cuts = tables.keep(islands(later))
    tables.only(cuts)
    return cuts


def islands(later: DataFrame) -> DataFrame:
    """(id, th, cuts): the stretches (first, last) of each text, joined where they meet, in order."""
    w = Window.partitionBy("id", "th").orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce(F.col("first") > F.col("reach") + 1, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    joined = later.withColumn("reach", reach).withColumn("island", island).groupBy("id", "th", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return joined.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """docs with repeated runs deleted from the text, and cut_lines, the number of lines deleted.

    A text of which every line goes becomes empty. Null and empty texts stay as they are. Repeated rows are
    one document and keep their lines, but those that repeat within it or from an earlier one. Rows with one
    id and different texts are documents of their own. Lines are compared by a 64-bit hash. An empty table
    gives no rows; other columns pass through, whatever their names, but a column cut_lines, which is replaced.
    """
    used = {"id": id_col, "text": text_col}
    own = tucked(docs, **used).withColumn("th", F.xxhash64("text"))
    found = repeats(own, least).select(F.col("id").alias("cut_id"), F.col("th").alias("cut_th"), "cuts")
    # Sorted and merged at every size: what is cut grows with the corpus and is never broadcast.
    joined = own.join(found.hint("merge"), F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("th") == F.col("cut_th")), "left")
    kept = F.filter(F.split("text", "\n"), lambda _, p: ~F.exists("cuts", lambda c: (p >= c["first"]) & (p <= c["last"])))
    cut = F.aggregate("cuts", F.lit(0).cast("bigint"), lambda x, c: x + (c["last"] - c["first"] + 1))
    joined = joined.withColumn("text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return joined.select(*untucked([c for c in docs.columns if c != "cut_lines"], **used), F.coalesce(cut, F.lit(0).cast("bigint")).alias("cut_lines"))


ORACLE = r"""
WITH lines AS (SELECT doc_id AS id, i - 1 AS pos, string_split(text, chr(10))[i] AS line
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM lines),
placed AS (SELECT *, (sum(n) OVER (PARTITION BY id ORDER BY pos))::BIGINT AS e FROM counted WHERE n > 0),
spans AS (SELECT id, sum(n) OVER w AS words, min(pos) OVER w AS first, max(pos) OVER w AS last, string_agg(line, chr(10)) OVER w AS span
    FROM placed WINDOW w AS (PARTITION BY id ORDER BY e - n RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
    UNION ALL SELECT id, sum(n) OVER w, min(pos) OVER w, max(pos) OVER w, string_agg(line, chr(10)) OVER w
    FROM placed WINDOW w AS (PARTITION BY id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
later AS (SELECT DISTINCT id, first, last FROM (SELECT *, min((id, first)) OVER (PARTITION BY span) AS a FROM spans WHERE words >= 50) WHERE (id, first) <> a),
cut AS (SELECT DISTINCT id, pos FROM lines JOIN later USING (id) WHERE pos BETWEEN first AND last),
kept AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN cut USING (id, pos) GROUP BY id)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(c.n, 0)::BIGINT AS cut_lines
FROM documents d LEFT JOIN kept k ON k.id = doc_id LEFT JOIN (SELECT id, count(*) AS n FROM cut GROUP BY id) c ON c.id = doc_id
"""
