"""URL filters: allow and block rules, and an empirical-Bayes reputation of hosts for all other pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule) of the query; a rule is a host and a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Second labels that make a suffix of two labels under a country's top label (as in co.uk). Fixed values.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case. Path: then up to ?, # or the
    end. Both are empty for null and for urls without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first by code point) and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Each rule overrides those before it.
    for says, text in sorted(sorted(rules, key=lambda r: r[1], reverse=True), key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain (the suffix and one label more) and the suffix of a host."""
    labels = F.split(host, r"\.")
    two = (F.length(F.element_at(labels, -1)) == 2) & (F.size(labels) > 2) & F.element_at(labels, F.when(F.size(labels) > 1, -2).otherwise(-1)).isin(*SECOND)
    tail = lambda n: F.substring_index(host, ".", -n)
    return F.when(two, tail(3)).otherwise(tail(2)), F.when(two, tail(2)).otherwise(tail(1))


def strength(groups: DataFrame, key: str, parent: str) -> DataFrame:
    """(parent, s): how many observations the prior of a level is worth, by the method of moments.

    groups has one row per parent and key with n and bad. The intra-class correlation r of the children of
    one parent is estimated from the spread of their rates beyond the binomial; s = 1 / r - 1, held between
    1 and 1000."""
    total = groups.groupBy(parent).agg(F.sum("n").alias("nn"), F.sum("bad").alias("bb"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("of_bad"))
    mean = F.col("bb") / F.col("nn")
    spread = F.col("of_bad") - F.col("bb") * mean
    within = mean * (1 - mean)
    room = F.col("nn") - F.col("squares") / F.col("nn") - (F.col("k") - 1)
    r = F.when((within > 0) & (room > 0), F.greatest((spread / within - (F.col("k") - 1)) / room, F.lit(0.0))).otherwise(F.lit(0.0))
    s = F.when(r > 0, F.least(F.greatest(1 / r - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(F.lit(1000.0))
    return total.select(parent, s.alias("s"))


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, bad, low): the lower posterior bound of each host's rate of bad pages.

    outcomes has one row per labelled page: host, bad (0 or 1). The rates are shrunk in a chain of
    beta-binomial priors, whose strengths are estimated from the data: a suffix towards all pages, a
    registered domain towards its suffix, a host towards its domain. low is the mean of the host's posterior
    less z of its standard deviations. All pages of a host are first added up on the map side.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad")).withColumns({"domain": domain, "suffix": suffix, "all": F.lit("")})
    level = lambda *keys: hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = level("all").select("all", (F.col("bad") / F.col("n")).alias("prior"))
    shrunk = (F.col("bad") + F.col("s") * F.col("prior")) / (F.col("n") + F.col("s"))

    def step(groups: DataFrame, key: str, parent: str, above: DataFrame) -> DataFrame:
        known = groups.join(above, parent).join(strength(groups, key, parent), parent)
        return known.select(key, shrunk.alias("prior"))

    suffixes = step(level("all", "suffix"), "suffix", "all", whole)
    domains = step(level("suffix", "domain"), "domain", "suffix", suffixes)
    known = hosts.join(domains, "domain").join(strength(hosts.select("domain", "host", "n", "bad"), "host", "domain"), "domain")
    a, b = F.col("bad") + F.col("s") * F.col("prior"), F.col("n") - F.col("bad") + F.col("s") * (1 - F.col("prior"))
    low = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return known.select("host", "n", "bad", low.alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, worst: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, n_labelled, n_bad, low) of each page; low is the bound, null for hosts without labelled pages.

    outcomes: (id, bad) of labelled pages, bad 0 or 1, several rows of an id counting each. Where a rule fits, it decides; else the page
    is blocked if the lower posterior bound of its host's rate of bad pages is above `worst`; hosts without
    labelled pages are allowed. Null urls and urls without :// have an empty host, judged like any host. Null outcomes don't
    count. Repeated rows are judged each; an empty table gives no rows; other columns are not read.
    """
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    split = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    labelled = split.select("id", "host").join(outcomes.toDF("id", "bad").filter("bad is not null"), "id")
    known = reputation(labelled)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > worst, "block").otherwise("allow")
    joined = split.join(known, "host", "left")
    return joined.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_labelled"), F.coalesce("bad", F.lit(0).cast("bigint")).alias("n_bad"), F.round("low", 9).alias("low"))


ORACLE = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
named AS (SELECT *, string_split(host, '.') AS l, len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AS two,
    array_to_string(l[-(CASE WHEN two THEN 3 ELSE 2 END):], '.') AS domain, array_to_string(l[-(CASE WHEN two THEN 2 ELSE 1 END):], '.') AS suffix FROM split),
hosts AS (SELECT host, domain, suffix, count(*) AS n, sum((b.quality = 0 OR b.toxic = 1)::INT)::BIGINT AS bad FROM named JOIN labels b ON b.doc_id = page_id
    WHERE (b.quality = 0 OR b.toxic = 1) IS NOT NULL GROUP BY ALL),
groups AS (SELECT 1 AS lev, '' AS parent, suffix AS k, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix
    UNION ALL SELECT 2, suffix, domain, sum(n), sum(bad) FROM hosts GROUP BY suffix, domain
    UNION ALL SELECT 3, domain, host, n, bad FROM hosts),
totals AS (SELECT lev, parent, sum(n) AS nn, sum(bad) AS bb, count(*) AS c, sum(n * n) AS squares, sum(bad * bad / n) AS of_bad FROM groups GROUP BY lev, parent),
spreads AS (SELECT *, bb / nn AS mean, of_bad - bb * (bb / nn) AS spread, nn - squares / nn - (c - 1) AS room FROM totals),
icc AS (SELECT *, CASE WHEN mean * (1 - mean) > 0 AND room > 0 THEN greatest((spread / (mean * (1 - mean)) - (c - 1)) / room, 0) ELSE 0 END AS r FROM spreads),
strengths AS (SELECT lev, parent, CASE WHEN r > 0 THEN least(greatest(1 / r - 1, 1), 1000) ELSE 1000 END AS s FROM icc),
p0 AS (SELECT sum(bad) / sum(n) AS prior FROM hosts),
p1 AS (SELECT k, (bad + s * prior) / (n + s) AS prior FROM groups JOIN strengths USING (lev, parent), p0 WHERE lev = 1),
p2 AS (SELECT g.k, (bad + s * prior) / (n + s) AS prior FROM groups g JOIN strengths USING (lev, parent) JOIN p1 ON p1.k = parent WHERE lev = 2),
p3 AS (SELECT g.k AS host, n, bad, bad + s * prior AS a, n - bad + s * (1 - prior) AS b FROM groups g JOIN strengths USING (lev, parent) JOIN p2 ON p2.k = parent WHERE lev = 3),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(says, own, start)),
fits AS (SELECT page_id, arg_max(own || start, length(own || start)) AS rule, arg_max(says, length(own || start)) AS says
    FROM split JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(n, 0)::BIGINT AS n_labelled, coalesce(bad, 0)::BIGINT AS n_bad, round(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) AS low
FROM split LEFT JOIN p3 USING (host) LEFT JOIN fits USING (page_id)
"""
