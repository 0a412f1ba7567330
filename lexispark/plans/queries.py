"""One query per operator over the driver's tables, with SQL for DuckDB beside it.

The dictionary: the words of each benchmark text two by two, with the item as target, and a few literal names that
differ in case, blanks and accents only. documents.text is clean_visible, pages.html is clean_html.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import normalize, tokens
from lexispark.functions.text import best_content
from lexispark.operators import annotate, match, names, token_match
from lexispark.sources.documents import lookup, write_documents
from lexispark.sources.names import from_json_maps, read_names
from lexispark.streaming.match import rated_stream, read_stream, write_stream

from .config import MatchConfig
from .job import matched
from .scratch import scratch, stored

LITERALS = (("of the", "t_of"), ("Of  The", "t_of_2"), ("für das", "t_fur"), ("FUR DAS", "t_fur_2"), ("que de", "t_que"), ("ión", "t_short"), ("is  and", "t_is"))
#: Names for the token matcher: tokens apart by a literal \W.
TOKEN_NAMES = ((r"of\Wthe", "t1"), (r"of\Wthe", "t2"), (r"que\Wde", "t3"), (r"The", "t4"), (r"und\Wdas", "t5"))
VISIBLE = {"clean_visible": "text"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.split("text", " ").alias("w"), F.col("item_id").cast("string").alias("target_id"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(2)), lambda i: F.array_join(F.slice("w", i, 2), " "))
    return words.select(F.explode(F.array_distinct(pairs)).alias("name"), "target_id").union(spark.createDataFrame(LITERALS, "name string, target_id string"))


def patterns(spark: SparkSession, d: str, **config) -> tuple[DataFrame, MatchConfig]:
    """The patterns are read several times: for their size, for the automaton and for their targets."""
    c = MatchConfig(**config)
    return stored(names.prepare(dictionary(spark, d), c)), c


def quoted(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def folded(x: str) -> str:
    points = "".join(f"\\x{{{ord(c):x}}}" for c in normalize.SPACES)
    return f"ltrim(regexp_replace(lower(strip_accents({x})), '[{points}]+', ' ', 'g'))"


NT = f"nt AS (SELECT DISTINCT array_to_string(w[i:i + 1], ' ') AS name, item_id::VARCHAR AS target_id FROM (SELECT w, item_id, unnest(range(1, len(w) + 1, 2)) AS i FROM (SELECT string_split(text, ' ') AS w, item_id FROM benchmark)) UNION ALL SELECT * FROM (VALUES {quoted(LITERALS)}) v(name, target_id))"
NAMED = f"{NT}, named AS (SELECT *, {folded('name')} AS norm_name FROM nt), good AS (SELECT * FROM named WHERE strlen(norm_name) BETWEEN 5 AND 1000)"
PAT = f"{NAMED}, pat AS (SELECT norm_name, min(name) AS name FROM good GROUP BY norm_name), pt AS (SELECT DISTINCT norm_name, target_id FROM good JOIN pat USING (norm_name, name))"
ND = f"nd AS (SELECT doc_id, {folded('text')} AS t FROM documents)"
FOUND = f"""{PAT}, {ND}, m(doc_id, norm_name, pos) AS (SELECT doc_id, norm_name, strpos(t, norm_name)::BIGINT FROM nd JOIN pat ON contains(t, norm_name)
    UNION ALL SELECT m.doc_id, m.norm_name, (m.pos + strpos(substr(nd.t, m.pos + 1), m.norm_name))::BIGINT FROM m JOIN nd USING (doc_id) WHERE strpos(substr(nd.t, m.pos + 1), m.norm_name) > 0),
    found AS (SELECT doc_id, norm_name, (pos - 1)::INT AS norm_start, (pos - 1 + length(norm_name))::INT AS norm_end FROM m),
    rated AS (SELECT DISTINCT doc_id, target_id FROM found JOIN pt USING (norm_name))"""
R = "WITH RECURSIVE"


def mentions(spark: SparkSession, d: str, **config) -> tuple[DataFrame, DataFrame]:
    p, c = patterns(spark, d, **config)
    return match.mentions(docs(spark, d), p, c), p


def rated(spark: SparkSession, d: str) -> DataFrame:
    found, p = mentions(spark, d)
    return annotate.ratings(found, p)


# Sources


@query("SELECT doc_id, strlen(text) AS n_bytes FROM documents WHERE lang = 'en'")
def scan_docs(spark, d):
    return table(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("SELECT * FROM documents")
def passthrough(spark, d):
    return table(spark, d, "documents")


@query("SELECT doc_id, text, substr(doc_id::VARCHAR, 1, 3) AS id_prefix FROM documents WHERE doc_id = 123")
def lookup_by_prefix(spark, d):
    """From a table written by prefix; a lookup reads one of its folders."""
    path = scratch(spark)
    write_documents(docs(spark, d), path, by_prefix=True)
    return lookup(spark.read.parquet(path), "123").withColumn("id_prefix", F.col("id_prefix").cast("string"))


@query("SELECT name, NULL::VARCHAR AS target_id FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS name FROM benchmark) WHERE name <> ''")
def names_simple(spark, d):
    path = scratch(spark)
    table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("value")).distinct().write.text(path)
    return read_names(spark, path, "lines")


@query(f"WITH {NT} SELECT name, target_id FROM nt")
def names_json_explode(spark, d):
    as_json = dictionary(spark, d).groupBy("target_id").agg(F.collect_list("name").alias("names")).select(F.to_json(F.create_map("target_id", "names")).alias("value"))
    return from_json_maps(as_json)


# Dictionary


@query(f"WITH {NT} SELECT name, string_agg(target_id, ',' ORDER BY target_id) AS target_ids FROM nt GROUP BY name")
def invert_names(spark, d):
    curated = dictionary(spark, d).groupBy("target_id").agg(F.collect_list("name").alias("names"))
    return names.invert(curated).select("name", F.array_join("target_ids", ",").alias("target_ids"))


@query(f"WITH {PAT} SELECT (SELECT count(DISTINCT name) FROM nt) AS n_names, (SELECT count(DISTINCT target_id) FROM nt) AS n_targets, count(*) AS n_patterns, min(strlen(norm_name)) AS min_bytes, max(strlen(norm_name)) AS max_bytes, sum(strlen(norm_name))::BIGINT AS total_bytes FROM pat")
def names_stats(spark, d):
    return names.counts(dictionary(spark, d)).crossJoin(names.stats(patterns(spark, d)[0]))


@query(f"WITH {NAMED} SELECT DISTINCT name, norm_name FROM named")
def normalize_names(spark, d):
    return names.normalize_names(dictionary(spark, d)).select("name", "norm_name").distinct()


@query(f"WITH {NAMED} SELECT name, target_id, strlen(norm_name) AS n_bytes FROM named WHERE strlen(norm_name) BETWEEN 6 AND 9")
def name_length_filter(spark, d):
    kept = names.within_length(names.normalize_names(dictionary(spark, d)), 6, 9)
    return kept.select("name", "target_id", F.octet_length("norm_name").cast("bigint").alias("n_bytes"))


@query(f"WITH {PAT} SELECT norm_name, p.name, string_agg(target_id, ',' ORDER BY target_id) AS target_ids FROM pat p JOIN pt USING (norm_name) GROUP BY ALL")
def dedupe_first_wins(spark, d):
    return patterns(spark, d)[0].select("norm_name", "name", F.array_join("target_ids", ",").alias("target_ids"))


@query(f"WITH {NAMED} SELECT norm_name, min(name) AS name, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS target_ids FROM good GROUP BY norm_name")
def dedupe_union(spark, d):
    return patterns(spark, d, duplicates="union")[0].select("norm_name", "name", F.array_join("target_ids", ",").alias("target_ids"))


@query(f"WITH {NAMED}, head AS (SELECT DISTINCT name FROM nt ORDER BY name LIMIT 10) SELECT norm_name, min(name) AS name FROM good WHERE name IN (SELECT name FROM head) GROUP BY norm_name")
def max_names(spark, d):
    return patterns(spark, d, max_names=10)[0].select("norm_name", "name")


RE2_SEP = r"[\x00 \t\n\r\-,.:''~`!@#$%^&*()_+={}\[\]|\\;\x22<>/?]+"
TOK = f"tok AS (SELECT name, list_filter(regexp_split_to_array(name, '{RE2_SEP}'), lambda t: t <> '') AS tokens FROM (SELECT text AS name FROM benchmark UNION SELECT url FROM pages))"


def raw_names(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("text").alias("name")).union(table(spark, d, "pages").select("url")).distinct()


@query(f"WITH {TOK} SELECT name, array_to_string(tokens, ' ') AS tokenized FROM tok")
def tokenize_names(spark, d):
    return raw_names(spark, d).select("name", tokens.tokenized(F.col("name")).alias("tokenized"))


@query(f"WITH {TOK} SELECT DISTINCT array_to_string(tokens, ' ') AS tokenized, len(tokens) AS n_tokens FROM tok WHERE len(tokens) >= 1 AND strlen(array_to_string(tokens, ' ')) BETWEEN 3 AND 1000")
def good_names_a(spark, d):
    return names.good_tokenized(raw_names(spark, d))


@query(f"WITH {TOK} SELECT name FROM tok WHERE strlen(name) BETWEEN 3 AND 64 AND len(tokens) > 0")
def good_names_b(spark, d):
    return names.good_raw(raw_names(spark, d))


@query(f"WITH {TOK}, g AS (SELECT DISTINCT array_to_string(tokens, ' ') AS t, len(tokens) AS n FROM tok WHERE len(tokens) >= 1 AND strlen(array_to_string(tokens, ' ')) BETWEEN 3 AND 1000) SELECT count(*) AS n_good, min(strlen(t)) AS min_bytes, max(strlen(t)) AS max_bytes, avg(strlen(t)) AS avg_bytes, avg(n) AS avg_tokens, sum(strlen(t))::BIGINT AS total_bytes FROM g")
def token_stats(spark, d):
    return names.token_stats(raw_names(spark, d))


RE2_NOT_SEP = "[^" + RE2_SEP[1:-1]
PAIRED = f"tk AS (SELECT url, list_filter(regexp_split_to_array(replace(url, '.', ''), '{RE2_SEP}'), lambda t: t <> '') AS e, list_filter(regexp_split_to_array(url, '{RE2_SEP}'), lambda t: t <> '') AS a, list_filter(regexp_split_to_array(replace(url, '://', ' '), '{RE2_SEP}'), lambda t: t <> '') AS b, list_filter(regexp_split_to_array(split_part(url, '/', 3), '{RE2_SEP}'), lambda t: t <> '') AS c FROM pages)"


@query(f"WITH {PAIRED} SELECT url, a = b AS same, a = e AS glued FROM tk")
def token_chain_eq(spark, d):
    without = lambda x, y: F.replace("url", F.lit(x), F.lit(y))
    return table(spark, d, "pages").select("url", tokens.same_chain(F.col("url"), without("://", " ")).alias("same"), tokens.same_chain(F.col("url"), without(".", "")).alias("glued"))


@query(f"WITH {PAIRED} SELECT url, a[1:len(c)] = c AS bare, a[2:len(c) + 1] = c AS after, CASE WHEN a[2:len(c) + 1] = c THEN coalesce(list_sum(list_transform(regexp_extract_all(split_part(url, '://', 2), '{RE2_SEP[:-1]}*{RE2_NOT_SEP}+')[1:len(c)], lambda p: length(p))), 0)::INT END AS ends FROM tk")
def token_chain_prefix(spark, d):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    return table(spark, d, "pages").select("url", tokens.is_head(host, F.col("url")).alias("bare"), tokens.is_head(host, rest).alias("after"), tokens.head_end(host, rest).alias("ends"))


# Texts


@query("SELECT coalesce(doc_id, page_id) AS doc_id, CASE WHEN html <> '' THEN html WHEN text <> '' THEN text END AS text, CASE WHEN html <> '' THEN 'clean_html' WHEN text <> '' THEN 'clean_visible' END AS content_form FROM documents FULL JOIN pages ON page_id = doc_id")
def best_text(spark, d):
    """Pages have html; of documents without a page the visible text is the next best."""
    both = docs(spark, d).join(table(spark, d, "pages"), F.col("doc_id") == F.col("page_id"), "full")
    text, form = best_content("clean_html", {"clean_visible": "text", "clean_html": "html"})
    return both.select(F.coalesce("doc_id", "page_id").alias("doc_id"), text.alias("text"), form.alias("content_form"))


@query(f"WITH {ND} SELECT doc_id, t AS norm FROM nd")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", normalize.normalized("text").alias("norm"))


@query(r"SELECT doc_id, ltrim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t-\r .]+', ' ', 'g')) AS norm FROM documents")
def normalize_ascii(spark, d):
    return docs(spark, d).select("doc_id", normalize.normalized_ascii(F.col("text")).alias("norm"))


@query("SELECT doc_id, text FROM documents")
def invalid_utf8_prefix(spark, d):
    """Behind each whole text stand a bad byte and the text once more; what stands before the bad byte counts."""
    utf8 = F.encode("text", "UTF-8")
    raw = docs(spark, d).select("doc_id", F.concat(utf8, F.lit(b"\xff"), utf8).alias("raw"))
    return raw.select("doc_id", normalize.decoded_prefix("raw").alias("text"))


# Matching


@query(f"{R} {FOUND} SELECT doc_id, norm_name, norm_start, norm_end FROM found")
def mentions_all(spark, d):
    found, p = mentions(spark, d)
    return found.join(p, "pattern_id").select("doc_id", "norm_name", "norm_start", "norm_end")


@query(f"{R} {FOUND} SELECT doc_id, norm_name, norm_start, norm_end FROM found")
def mentions_joined(spark, d):
    p, c = patterns(spark, d)
    return match.joined_mentions(docs(spark, d), p, c).join(p, "pattern_id").select("doc_id", "norm_name", "norm_start", "norm_end")


RAW = f"""{NT}, rp AS (SELECT DISTINCT name FROM nt WHERE strlen(name) BETWEEN 5 AND 1000), m(doc_id, name, pos) AS (SELECT doc_id, name, strpos(text, name)::BIGINT FROM documents JOIN rp ON contains(text, name)
    UNION ALL SELECT m.doc_id, m.name, (m.pos + strpos(substr(text, m.pos + 1), m.name))::BIGINT FROM m JOIN documents d ON d.doc_id = m.doc_id WHERE strpos(substr(text, m.pos + 1), m.name) > 0)"""


@query(f"{R} {RAW} SELECT m.doc_id, name, (pos - 1)::INT AS start_char, (pos - 1 + length(name))::INT AS end_char, strlen(substr(text, 1, pos - 1))::INT AS start_byte, (strlen(substr(text, 1, pos - 1)) + strlen(name))::INT AS end_byte, name AS value FROM m JOIN documents d ON d.doc_id = m.doc_id")
def match_raw(spark, d):
    found, p = mentions(spark, d, normalize="none")
    return found.join(p, "pattern_id").select("doc_id", "name", "start_char", "end_char", "start_byte", "end_byte", "value")


@query(f"{R} {RAW} SELECT m.doc_id, name, name AS value, name AS again, count(*) AS n FROM m JOIN documents d ON d.doc_id = m.doc_id GROUP BY ALL")
def mention_values(spark, d):
    from lexispark.functions.text import bytes_between

    found, p = mentions(spark, d, normalize="none")
    again = found.join(docs(spark, d), "doc_id").withColumn("again", bytes_between(F.col("text"), F.col("start_byte"), F.col("end_byte")))
    return again.join(p, "pattern_id").groupBy("doc_id", "name", "value", "again").agg(F.count("*").alias("n"))


@query(f"{R} {FOUND} SELECT doc_id, norm_name, count(*) AS n, count(*) AS n_same FROM found GROUP BY doc_id, norm_name")
def mention_offsets(spark, d):
    """The surface text of each mention, normalized, is its name, but for a blank at its end."""
    found, p = mentions(spark, d)
    same = F.rtrim(normalize.normalized("value")) == F.rtrim("norm_name")
    return found.join(p, "pattern_id").withColumn("same", same).groupBy("doc_id", "norm_name").agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"))


@query(f"WITH {PAT}, {ND} SELECT doc_id FROM nd WHERE EXISTS (SELECT 1 FROM pat WHERE contains(t, norm_name))")
def filter_docs(spark, d):
    p, c = patterns(spark, d)
    return match.keep_documents(docs(spark, d), p, c).select("doc_id")


@query(f"WITH {PAT}, {ND} SELECT doc_id FROM nd WHERE EXISTS (SELECT 1 FROM pat WHERE contains(t, norm_name))")
def filter_docs_joined(spark, d):
    p, c = patterns(spark, d, max_broadcast=0)
    return match.keep_documents(docs(spark, d), p, c).select("doc_id")


@query(f"WITH {PAT}, {ND} SELECT doc_id FROM nd WHERE NOT EXISTS (SELECT 1 FROM pat WHERE contains(t, norm_name))")
def filter_docs_negate(spark, d):
    p, c = patterns(spark, d, negate=True)
    return match.keep_documents(docs(spark, d), p, c).select("doc_id")


PLAIN = lambda x: f"ltrim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\t-\\r .]+', ' ', 'g'))"
#: Every character of a text that stays, with its place; only the first of a run of blanks stays, and none at the begin.
ASCII_FOUND = f"""{NT}, ap AS (SELECT DISTINCT {PLAIN('name')} AS norm FROM nt WHERE strlen({PLAIN('name')}) BETWEEN 5 AND 1000),
    an AS (SELECT doc_id, text, {PLAIN('text')} AS t FROM documents),
    m(doc_id, norm, pos) AS (SELECT doc_id, norm, strpos(t, norm)::BIGINT FROM an JOIN ap ON contains(t, norm)
    UNION ALL SELECT m.doc_id, m.norm, (m.pos + strpos(substr(an.t, m.pos + 1), m.norm))::BIGINT FROM m JOIN an USING (doc_id) WHERE strpos(substr(an.t, m.pos + 1), m.norm) > 0),
    runs AS (SELECT doc_id, regexp_extract_all(text, '[\\t-\\r .]+|[^\\t-\\r .]') AS r FROM documents WHERE doc_id IN (SELECT doc_id FROM m)),
    lens AS (SELECT doc_id, list_transform(CASE WHEN regexp_matches(r[1], '^[\\t-\\r .]') THEN r[2:] ELSE r END, lambda x: length(x)) AS l, CASE WHEN regexp_matches(r[1], '^[\\t-\\r .]') THEN length(r[1]) ELSE 0 END AS skipped FROM runs),
    ends AS (SELECT doc_id, norm, pos, skipped + coalesce(list_sum(l[1:pos - 1]), 0) AS a, skipped + coalesce(list_sum(l[1:pos - 1 + length(norm)]), 0) AS b FROM m JOIN lens USING (doc_id))"""


@query(f"{R} {ASCII_FOUND} SELECT doc_id, norm AS norm_name, a::INT AS start_char, b::INT AS end_char, strlen(substr(text, 1, a::BIGINT))::INT AS start_byte, substr(text, a::BIGINT + 1, (b - a)::BIGINT) AS value FROM ends JOIN an USING (doc_id)")
def match_ascii(spark, d):
    found, p = mentions(spark, d, normalize="ascii")
    return found.join(p, "pattern_id").select("doc_id", "norm_name", "start_char", "end_char", "start_byte", "value")


@query(f"{R} {ASCII_FOUND} SELECT doc_id, norm AS norm_name, a::INT AS start_char, b::INT AS end_char, strlen(substr(text, 1, a::BIGINT))::INT AS start_byte, substr(text, a::BIGINT + 1, (b - a)::BIGINT) AS value FROM ends JOIN an USING (doc_id)")
def match_ascii_joined(spark, d):
    found, p = mentions(spark, d, normalize="ascii", max_broadcast=0)
    return found.join(p, "pattern_id").select("doc_id", "norm_name", "start_char", "end_char", "start_byte", "value")


@query(f"{R} {FOUND} SELECT doc_id, norm_end, arg_max(norm_name, length(norm_name)) AS norm_name, count(*) AS match_num FROM found GROUP BY doc_id, norm_end")
def match_events(spark, d):
    found, p = mentions(spark, d)
    return match.events(found).join(p, "pattern_id").select("doc_id", "norm_end", "norm_name", "match_num")


#: Tokens with the place of each, and mentions of names of one token or two, of which the second does not begin like the first.
TOKEN_FOUND = rf"""pieces AS (SELECT doc_id, i, p[i] AS piece FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[ \n\t\r]*[^ \n\t\r]+') AS p FROM documents))),
    tk AS (SELECT doc_id, i, ltrim(piece, chr(32) || chr(10) || chr(9) || chr(13)) AS tok, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(tok) AS pos FROM pieces),
    tn AS (SELECT name, string_split(name, '\W') AS t, string_agg(target_id, ',' ORDER BY target_id) AS target_ids FROM (VALUES {quoted(TOKEN_NAMES)}) v(name, target_id) GROUP BY name),
    tm AS (SELECT a.doc_id, name, a.pos::INT AS first, CASE WHEN len(t) = 1 THEN length(t[1]) ELSE b.pos + length(t[2]) - a.pos END::INT AS length, target_ids
    FROM tk a JOIN tn ON starts_with(a.tok, t[1]) LEFT JOIN tk b ON b.doc_id = a.doc_id AND b.i = a.i + 1 WHERE len(t) = 1 OR starts_with(b.tok, t[2]))"""


def token_names(spark) -> DataFrame:
    return spark.createDataFrame(TOKEN_NAMES, "name string, target_id string")


@query(f"WITH {TOKEN_FOUND} SELECT doc_id, name, first, length, target_ids FROM tm")
def token_mentions(spark, d):
    return token_match.mentions(docs(spark, d), token_names(spark)).select("doc_id", "name", "first", "length", F.array_join("target_ids", ",").alias("target_ids"))


@query(f"WITH {TOKEN_FOUND} SELECT doc_id, unnest(string_split(target_ids, ',')) AS target_id, first, length FROM tm")
def token_labels(spark, d):
    return token_match.labels(token_match.mentions(docs(spark, d), token_names(spark)))


@query(f"WITH {TOKEN_FOUND}, each AS (SELECT doc_id, name, first, unnest(string_split(target_ids, ',')) AS target_id FROM tm) SELECT doc_id, string_agg(target_id || ' ' || first, ',' ORDER BY name, first, target_id) AS labels, count(*) AS n_ratings FROM each GROUP BY doc_id")
def token_labels_nested(spark, d):
    full = match.filter_made(token_match.with_labels(docs(spark, d), token_names(spark)), F.col("labels").isNotNull())
    entry = lambda c: F.col(c)[MatchConfig.annotator_id]
    spelt = F.transform(entry("labels"), lambda x: F.concat_ws(" ", x["target"]["target_id"], x["first"].cast("string")))
    return full.select("doc_id", F.array_join(spelt, ",").alias("labels"), F.size(entry("ratings")).cast("bigint").alias("n_ratings"))


# Annotation


@query(f"{R} {FOUND} SELECT doc_id, target_id FROM rated")
def ratings(spark, d):
    return rated(spark, d)


@query(f"{R} {FOUND} SELECT doc_id, string_agg(target_id, ',' ORDER BY target_id) AS target_ids FROM rated GROUP BY doc_id")
def ratings_joined(spark, d):
    p, c = patterns(spark, d, max_broadcast=0)
    full = match.filter_made(matched(docs(spark, d), p, c, VISIBLE), F.size("targets") > 0)
    return full.select("doc_id", F.array_join("targets", ",").alias("target_ids"))


@query(f"{R} {FOUND} SELECT doc_id, string_agg(target_id, ',' ORDER BY target_id) AS target_ids FROM rated GROUP BY doc_id")
def ratings_nested(spark, d):
    p, c = patterns(spark, d)
    full = match.filter_made(annotate.annotated(matched(docs(spark, d), p, c, VISIBLE), c), F.size("targets") > 0)
    record = F.transform(F.col("ratings")[c.annotator_id], lambda r: r["target"]["target_id"])
    return full.select("doc_id", F.array_join(record, ",").alias("target_ids"))


@query(f"{R} {FOUND} SELECT doc_id, norm_name, norm_start, (row_number() OVER (PARTITION BY doc_id ORDER BY norm_end, norm_start) - 1)::INT AS token_num FROM found")
def token_num(spark, d):
    found, p = mentions(spark, d)
    return found.join(p, "pattern_id").select("doc_id", "norm_name", "norm_start", "token_num")


@query(f"{R} {FOUND} SELECT d.doc_id, count(f.doc_id)::INT AS n_tokens FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id WHERE text <> '' GROUP BY d.doc_id")
def sentences_nested(spark, d):
    p, c = patterns(spark, d)
    full = annotate.annotated(matched(docs(spark, d), p, c, VISIBLE), c)
    return full.filter("sentences is not null").select("doc_id", F.size(F.col("sentences")[c.annotator_id][0]["tokens"]).alias("n_tokens"))


@query(f"WITH {PAT}, {ND}, k AS (SELECT doc_id FROM nd WHERE EXISTS (SELECT 1 FROM pat WHERE contains(t, norm_name))) SELECT CASE WHEN k.doc_id IS NULL THEN '' ELSE d.doc_id::VARCHAR END AS doc_id, CASE WHEN k.doc_id IS NULL THEN '' ELSE d.text END AS text FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id")
def emit_empties(spark, d):
    p, c = patterns(spark, d)
    found = docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "text", match.has_mention(p, c).alias("kept"))
    return annotate.blank_unmatched(found, F.col("kept")).select("doc_id", "text")


@query(f"{R} {FOUND} SELECT (SELECT count(*) FROM documents) AS processed, (SELECT count(DISTINCT doc_id) FROM found) AS matched, (SELECT count(DISTINCT doc_id) FROM found) AS written, (SELECT count(*) FROM found) AS mentions, (SELECT count(*) FROM rated) AS ratings, (SELECT count(*) FROM rated)::DOUBLE / (SELECT count(DISTINCT doc_id) FROM found) AS ratings_per_written")
def run_summary(spark, d):
    p, c = patterns(spark, d)
    return annotate.summary(matched(docs(spark, d), p, c, VISIBLE), c)


@query(f"{R} {FOUND} SELECT norm_name, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY norm_name")
def mention_counts(spark, d):
    found, p = mentions(spark, d)
    return found.groupBy("pattern_id").agg(F.count("*").alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs")).join(p, "pattern_id").select("norm_name", "n_mentions", "n_docs")


@query(f"{R} {FOUND} SELECT doc_id, count(*) AS n_targets FROM rated GROUP BY doc_id")
def targets_per_doc(spark, d):
    return annotate.targets_per_document(rated(spark, d))


@query("SELECT count(text) AS n_texts, sum(strlen(text))::BIGINT AS bytes FROM documents")
def content_bytes(spark, d):
    return annotate.content_bytes(docs(spark, d))


@query(f"WITH {PAT}, {ND}, head AS (SELECT * FROM nd ORDER BY doc_id LIMIT 100) SELECT doc_id FROM head WHERE EXISTS (SELECT 1 FROM pat WHERE contains(t, norm_name))")
def max_items(spark, d):
    p, c = patterns(spark, d, max_items=100)
    return match.keep_documents(annotate.first_items(docs(spark, d), c.max_items), p, c).select("doc_id")


@query(f"{R} {FOUND} SELECT doc_id, target_id FROM rated")
def stream_ratings(spark, d):
    p, c = patterns(spark, d)
    path = scratch(spark)
    stream = read_stream(spark, f"{d}/documents.parque[t]", table(spark, d, "documents").schema.simpleString()[7:-1].replace(":", " ")).select("doc_id", "text")
    write_stream(rated_stream(stream, p, c, VISIBLE).select("doc_id", "targets"), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", F.explode("targets").alias("target_id"))
