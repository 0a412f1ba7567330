"""Quality rules: a table of thresholds compiled into one projection over the metrics of each text."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_after, tucked, untucked, words

#: Frequent function words of English, French, German and Spanish. Fixed values.
STOP_WORDS = (
    "a an and are as at be by for from have in is it of on or that the this to was were which with you "
    "au aux avec ce dans de des du elle en est et il la le les mais ne nous on ou par pas pour que qui se son sur un une vous "
    "als auch auf aus bei das dem den der des die ein eine einen er es für im ist mit nicht noch sich sie sind so und von war wie zu "
    "al como con de del el ella en es esta la las lo los más no para pero por que se sin su un una y"
).split()
SYMBOLS = "#*$%&|<>"

#: metric, least and greatest value allowed (None: no bound). A document fails if any metric is out of bounds.
RULES = (
    ("n_words", 20, None),
    ("mean_word_chars", 2.0, 16.0),
    ("symbols_per_word", None, 0.1),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def repeated_words(df: DataFrame) -> DataFrame:
    """Turns _h, the hashes of the words of a text, into n_repeat_words: the number of words that lie in a
    window of 8 words found twice or more in the text, first one included.

    A window's hash is made of the hashes of its halves. Texts without a repeated window of 4 words end there.
    For the others the hashes of the windows are sorted with their positions, those with an equal neighbour
    are kept, and the stretches they cover are added up. Every step is linear or a sort. Each array is a
    column of its own, for a lambda would compute it anew per element.
    """
    rest = [c for c in df.columns if c != "_h"]

    def doubled(column: str, gap: int):
        return F.transform(column, lambda h, i: F.xxhash64(h, F.get(column, i + gap)))

    def distinct(column: str):
        return F.size(F.array_distinct(column))

    df = df.select(*rest, doubled("_h", 1).alias("_g"), F.greatest(F.size("_h") - 7, F.lit(0)).alias("_n"))
    df = df.select(*rest, "_n", doubled("_g", 2).alias("_g"))
    df = df.select(*rest, F.when((F.col("_n") > 1) & (distinct("_g") < F.col("_n") + 4), F.slice(doubled("_g", 4), F.lit(1), F.col("_n"))).alias("_g"))
    df = df.select(*rest, F.when(distinct("_g") < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_r"))
    here = lambda k: F.get("_r", k)["h"]
    twin = F.filter(F.transform("_r", lambda r, k: F.when((r["h"] == here(k - 1)) | (r["h"] == here(k + 1)), r["i"])), lambda i: i.isNotNull())
    df = df.select(*rest, F.sort_array(twin).alias("_p"))
    steps = F.transform("_p", lambda p, k: F.least(F.lit(8), F.coalesce(F.get("_p", k + 1) - p, F.lit(8))))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return df.select(*rest, F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"))


def metrics(docs: DataFrame) -> DataFrame:
    """Adds one struct column `q` with the counts of each text to rows (text, row)."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(
        "text",
        "row",
        words(F.col("text")).alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("_l"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("bigint").alias("_s"),
    )
    count = lambda x: F.size(x).cast("bigint")
    df = df.select(
        "text",
        "row",
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        F.struct(
            count("_w").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
            F.col("_s").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct(F.transform("_l", lambda x: F.xxhash64(x))))).cast("bigint").alias("n_dup_lines"),
            count("_l").alias("n_lines"),
            count(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"),
            count(F.filter("_l", lambda x: F.ltrim(x).rlike("^[-*•]"))).alias("n_bullet_lines"),
            count(F.filter("_l", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))).alias("n_ellipsis_lines"),
        ).alias("q"),
    )
    df = repeated_words(df)
    return df.select("text", "row", F.col("q").withField("n_repeat_words", F.col("n_repeat_words")).alias("q"))


def compiled(q: str = "q", rules=RULES) -> Column:
    """The table of rules as one boolean expression over the struct of metrics."""
    value = {
        "mean_word_chars": ratio(F.col(f"{q}.word_chars"), F.col(f"{q}.n_words")),
        "symbols_per_word": ratio(F.col(f"{q}.n_symbols"), F.col(f"{q}.n_words")),
        "stop_word_ratio": ratio(F.col(f"{q}.n_stop_words"), F.col(f"{q}.n_words")),
        "dup_line_ratio": ratio(F.col(f"{q}.n_dup_lines"), F.col(f"{q}.n_lines")),
        "bullet_line_ratio": ratio(F.col(f"{q}.n_bullet_lines"), F.col(f"{q}.n_lines")),
        "ellipsis_line_ratio": ratio(F.col(f"{q}.n_ellipsis_lines"), F.col(f"{q}.n_lines")),
    }
    tests = []
    for metric, low, high in rules:
        x = value.get(metric, F.col(f"{q}.{metric}"))
        tests += [x >= low] * (low is not None) + [x <= high] * (high is not None)
    return reduce(and_, tests, F.lit(True))


def judged(docs: DataFrame, text_col: str, rules) -> DataFrame:
    """(text, row, q, base_failed, kept)."""
    failed = (F.col("q.n_words") < 20) | (100 * F.col("q.n_repeat_words") > 30 * F.col("q.n_words"))
    return metrics(tucked(docs, text=text_col)).withColumn("base_failed", failed).withColumn("kept", ~failed & compiled("q", rules))


def judge(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """docs with `q` (counts), base_failed and kept; columns of these three names are replaced, all others pass through.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows of 8 words. kept: not
    base_failed and every rule of the table holds. Null and empty texts have no words and fail. Repeated rows
    are judged each; an empty table gives no rows.
    """
    made = ("q", "base_failed", "kept")
    return judged(docs, text_col, rules).select(*untucked([c for c in docs.columns if c not in made], text=text_col), *made)


def keep(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that judge keeps, with the columns of docs, whatever their names."""
    return filter_after(judged(docs, text_col, rules), F.col("kept")).select(*untucked(docs.columns, text=text_col))


ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
counts AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop,
    len(list_filter(ls, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullet, len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) AS n_ellipsis
    FROM w LEFT JOIN cover USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 16.0 AND n_symbols / n_words <= 0.1::DOUBLE AND n_stop / n_words >= 0.02::DOUBLE
    AND n_dup_lines / n_lines <= 0.5::DOUBLE AND n_bullet / n_lines <= 0.9::DOUBLE AND n_ellipsis / n_lines <= 0.3::DOUBLE AS kept
FROM failed
"""
