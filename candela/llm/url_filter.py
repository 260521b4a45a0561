"""URL rules: which allow or block rule fits a URL best.

A URL is expanded into host suffixes and path prefixes, as lookups against hashed block lists do. The expressions meet the rules by
an equi-join on the first 32 bits of their SHA-256; the full digest and the rule's whole path confirm a meeting, and the longest
rule wins. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.columns import packed, quoted, unpacked
from candela.llm.registry import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8  # hex digits of the digest that make the join key
RESULTS = ["host", "path", "rule", "verdict"]
RULES = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "verdict")])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: the host lies between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the
    path goes on up to ``?``, ``#`` or the end. Without ``://``, or for null, both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _labels(host: Column) -> Column:
    return F.split(host, r"\.")


def _folder(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, "^(?s)(.*/)", 1)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their join keys. A null path counts as empty; a rule without host, or without the verdict
    ``allow`` or ``block``, fits nothing. Equal rules merge; if they differ in their verdict, ``block`` holds."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    path = F.coalesce(F.col("path"), F.lit(""))
    one = (
        rules.filter("host <> '' AND verdict IN ('allow', 'block')")
        .groupBy(host.alias("rule_host"), path.alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
    )
    digest = _digest(F.concat("rule_host", _folder(F.col("rule_path"))))
    return one.withColumn("digest", digest).withColumn("short", F.substring(digest, 1, SHORT))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every page with ``host``, ``path``, the best ``rule`` (host and path joined; null if none fits) and its ``verdict``.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits its host and all subdomains if the page's path starts
    with the rule's path. The longest rule wins; at equal length the longer host, then ``block``. No rule: ``default``.
    A null or malformed URL has an empty host and path and gets ``default``. Repeated rows stay, each judged alike; an empty table
    gives an empty result. Input columns named like a result are replaced by it, all others are kept.
    """
    fitted = prepared_rules(rules)
    # Two numbers bound the expansion exactly: no rule has more host labels or more slashes than these.
    most = fitted.agg(
        F.max(F.size(_labels(F.col("rule_host")))), F.max(F.char_length(F.regexp_replace("rule_path", "[^/]", "")))
    ).first()
    labels, slashes = (most[0] or 0), (most[1] or 0)

    host, path = host_and_path(F.col(quoted(url)))
    rows = packed(pages, host.alias("host"), path.alias("path"))
    places = rows.select("host", "path").distinct()
    parts = F.split("path", "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(_labels(F.col("host"))), F.lit(labels))),
        lambda k: F.array_join(F.slice(_labels(F.col("host")), -k, k), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(slashes))),
        lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))),
    )
    expanded = (
        places.filter(F.lit(labels) > 0)
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("expression", F.concat("suffix", "prefix"))
        .withColumn("short", F.substring(_digest(F.col("expression")), 1, SHORT))
    )
    met = (
        expanded.join(fitted, "short")
        .filter(_digest(F.col("expression")) == F.col("digest"))
        .filter((F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    )
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(
        F.char_length(rule), F.char_length("rule_host"), F.col("rule_verdict").alias("verdict"), rule.alias("rule")
    )
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    judged = rows.join(best, ["host", "path"], "left").select(
        "*", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
    return unpacked(judged, pages.columns, RESULTS)


RULE_LIST = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query(
    "op1_url_filter",
    """
WITH rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
  ('org', '/fr/', 'allow')),
cut AS (SELECT row_number() OVER () AS n, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (SELECT n, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv FROM parts, rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)""",
)
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULE_LIST, RULES)
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", *RESULTS)
