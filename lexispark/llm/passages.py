"""Repeated passages, found by winnowing over word windows, wherever they stand in their lines.

A window is `least` consecutive words of a text. A window that starts later in the corpus than an equal one
repeats it; every word of a repeating window is deleted. The corpus is ordered by id (null first), text hash and word.

Winnowing: the mark of a window is the smallest hash of its grams (GRAM consecutive words). Equal windows have
equal marks, so a window whose mark is found in one text only, and which is no part of a text that repeats a
gram, has no equal and goes no further. The others are joined on the hash of the whole window; neighbouring windows overlap, so
that a run extends word by word both ways.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, Tables, let, tucked, untucked, words
from .lines import islands

GRAM = 8


def window_marks(text: Column, least: int) -> tuple[Column, Column]:
    """The mark of every window of a text, in order, and whether a gram repeats in it."""
    gram = min(GRAM, least)
    grams = let(words(text), lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (gram - 1), F.lit(0))), lambda _, i: F.xxhash64(F.slice(ws, i + 1, gram))))
    # The smallest of 1, 2, 4, ... grams from each on, then of all of a window.
    reach, steps = 1, []
    while reach < least - gram + 1:
        steps.append(min(reach, least - gram + 1 - reach))
        reach += steps[-1]

    def smaller(step: int) -> Callable[[Column], Column]:
        # The lambda has one parameter: transform would take a second one for the index.
        return lambda m: F.zip_with(m, F.slice(m, 1 + step, F.size(m)), lambda x, y: F.least(x, y))

    def shrunk(hashes: Column) -> Column:
        out = hashes
        for step in steps:
            out = let(out, smaller(step))
        return let(out, lambda m: F.slice(m, 1, F.greatest(F.size(m) - (least - gram), F.lit(0))))

    both = let(grams, lambda g: F.struct(shrunk(g).alias("marks"), (F.size(F.array_distinct(g)) < F.size(g)).alias("twice")))
    return both["marks"], both["twice"]


def repeats(tables: Tables, docs: DataFrame, least: int) -> DataFrame:
    """(id, th, cuts): the stretches of words to delete from each text (id, text, th) that has any, in order."""
    marks, twice = window_marks(F.col("text"), least)
    keyed = docs.filter("text is not null").select("id", "th", "text")
    found = keyed.select("id", "th", let(F.struct(marks.alias("marks"), twice.alias("twice")), lambda s: F.struct(F.array_distinct(s["marks"]).alias("marks"), s["twice"].alias("twice"))).alias("s"))
    found = tables.keep(found.select("id", "th", "s.twice", F.explode("s.marks").alias("mark")))
    place = F.struct("id", "th")
    met = found.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("mark")
    shared = found.join(met, "mark", "left_semi").select("id", "th", "mark", F.lit(False).alias("twice"))
    shared = shared.union(found.filter("twice").select("id", "th", "mark", "twice"))
    chosen = tables.keep(shared.groupBy("id", "th").agg(F.collect_set("mark").alias("chosen")).withColumnRenamed("id", "of_id").withColumnRenamed("th", "of_th"))
    again = keyed.join(chosen.hint("merge"), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th"))).select("id", "th", "text", "chosen")
    at = F.filter(F.transform(marks, lambda m, i: F.when(F.array_contains("chosen", m), i)), lambda i: i.isNotNull())
    windows = let(words(F.col("text")), lambda ws: F.transform(at, lambda i: F.struct(i.alias("first"), F.xxhash64(F.slice(ws, i + 1, least)).alias("window"))))
    windows = tables.keep(again.select("id", "th", F.explode(windows).alias("w")).select("id", "th", "w.first", "w.window"))
    start = F.struct("id", "th", "first")
    firsts = windows.groupBy("window").agg(F.min(start).alias("a"), F.max(start).alias("b")).filter("a <> b").select("window", "a")
    later = windows.join(firsts, "window").filter(start != F.col("a")).select("id", "th", "first", (F.col("first") + (least - 1)).alias("last")).distinct()
    cuts = tables.keep(islands(later))
    tables.only(cuts)
    return cuts


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """docs with repeated passages of `least` words or more deleted from the text, and cut_words, the number of
    words deleted.

    The white space before a passage stays and that after it goes; a line end after it stays if none stands before. Words and
    windows are compared by 64-bit hashes. Null and empty texts stay as they are. Repeated rows are one document
    and keep what does not repeat within it or from an earlier one. Rows with one id and different texts are
    documents of their own. An empty table gives no rows; other columns pass through, whatever their names, but a column cut_words,
    which is replaced.
    """
    used, tables = {"id": id_col, "text": text_col}, Tables(docs.sparkSession)
    own = tucked(docs, **used).withColumn("th", F.xxhash64("text"))
    found = repeats(tables, own, least).select(F.col("id").alias("cut_id"), F.col("th").alias("cut_th"), "cuts")
    joined = own.join(found.hint("merge"), F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("th") == F.col("cut_th")), "left")

    def kept(tokens: Column) -> Column:
        """Tokens are words with the white space after them."""
        ends = lambda t: F.contains(t, F.lit("\n"))
        broken = lambda t, p: ends(t) & F.exists("cuts", lambda c: (p == c["last"]) & (c["first"] > 0) & ~F.coalesce(ends(F.get(tokens, (c["first"] - 1).cast("int"))), F.lit(False)))
        left = lambda t, p: F.when(~F.exists("cuts", lambda c: (p >= c["first"]) & (p <= c["last"])), t).when(broken(t, p), F.lit("\n")).otherwise(F.lit(""))
        return F.array_join(F.transform(tokens, left), "")

    text = F.col("text")
    tokens = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1)
    cut = F.aggregate("cuts", F.lit(0).cast("bigint"), lambda x, c: x + (c["last"] - c["first"] + 1))
    new = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.regexp_extract(text, f"^{GAP}", 0), let(tokens, kept)))
    return joined.withColumn("text", new).select(*untucked([c for c in docs.columns if c != "cut_words"], **used), F.coalesce(cut, F.lit(0).cast("bigint")).alias("cut_words"))
