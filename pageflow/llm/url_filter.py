"""URL filters by host-suffix and path-prefix expressions (operator 11).

A rule is (host, path, action). It fits a URL whose host is the rule's or below it and whose path starts with the
rule's; the longest rule that fits decides, else ``default``.

The rules become a table of digests with a short hash prefix (four bytes of SHA-256). Each URL is expanded into the
suffixes of its host, and these meet the rules' hosts by an equi-join on the short prefix, confirmed on the full
digest. A host that has rules brings the lengths of their paths, so that the URL is then expanded into exactly those
host-suffix and path-prefix expressions that some rule could equal; these meet the rules in the same way. Of the
confirmed rules of a URL the longest text wins.

Nothing grows with (URLs x rules): a URL has at most as many suffixes as the deepest rule host has labels (one
number, taken from the rules), and as many prefixes as its rule hosts have path lengths. Expressions that many URLs
share (``com``, a hot site) are dealt over several tasks; the rules' side holds each expression once. Whether it is
broadcast is Spark's choice by its size.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case (port and user stay);
path: from there up to ``?``, ``#`` or the end. Null URLs and such without ``://`` have an empty host and path, fit
no rule and get the default. Rules with an empty host, or a path that is neither empty nor starts with ``/``, fit
nothing. The same rule twice counts once; with both actions, ``block`` holds. Repeated rows are judged each, other
columns aren't read, null keys stay, an empty table of URLs gives an empty result and empty rules give the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm.common import ascii_lower, table, written
from pageflow.operators.skew import salted_join

#: The rules of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
RULE_SCHEMA = "host string, path string, action string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    behind = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(behind, r"^[^?#]*+", 0)


def _hashed(df: DataFrame, expression: str, digest: str) -> DataFrame:
    """``df`` with the digest of an expression and ``short``, the digest's first four bytes."""
    df = df.withColumn(digest, F.unhex(F.sha2(F.col(expression), 256)))
    return df.withColumn("short", F.conv(F.hex(F.substring(F.col(digest), 1, 4)), 16, 10).cast("bigint"))


def rule_tables(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules as (short, rule_digest, rule, rule_host, action), and their hosts as (short, host_digest, lengths)."""
    named = rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action")
    fit = (F.col("rule_host") != "") & ~F.col("rule_host").rlike("[/?#]") & ~F.col("rule_path").rlike("[?#]") & ((F.col("rule_path") == "") | F.col("rule_path").startswith("/"))
    one = named.filter(fit & F.col("action").isin("allow", "block")).groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
    hosts = one.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    whole = _hashed(one.select(F.concat("rule_host", "rule_path").alias("rule"), "rule_host", "action"), "rule", "rule_digest")
    return whole, _hashed(hosts, "rule_host", "host_digest").select("short", "host_digest", "lengths")


def host_suffixes(host: str, labels: int) -> Column:
    """The suffixes of a host at its dots, of at most ``labels`` labels."""
    n = F.least(F.size(F.split(F.col(host), r"\.")), F.lit(max(1, labels)))
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.call_function("substring_index", F.col(host), F.lit("."), -k))


def fitting_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule, rule_host, action): every rule that fits a row of ``rows`` (row, host, path)."""
    whole, hosts = rule_tables(rules)
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    suffixes = rows.filter("host <> ''").select("row", "path", F.explode(host_suffixes("host", deepest)).alias("suffix"))
    met = salted_join(_hashed(suffixes, "suffix", "digest"), hosts, ["short"]).filter("digest = host_digest")
    lengths = F.filter("lengths", lambda n: n <= F.length("path"))
    prefixes = met.select("row", F.explode(F.transform(lengths, lambda n: F.concat("suffix", F.substring(F.col("path"), F.lit(1), n)))).alias("expression"))
    both = salted_join(_hashed(prefixes, "expression", "digest"), whole, ["short"]).filter("digest = rule_digest")
    return both.select("row", "rule", "rule_host", "action")


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``pages``."""
    host, path = host_and_path(F.col(url))
    numbered = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    rows = written(numbered, "urls")
    # longest text first, then the more exact host; no two rules of a URL agree in both
    rank = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "action")
    best = fitting_rules(rows, rules).groupBy("row").agg(F.max(rank).alias("best"))
    judged_rows = rows.join(best, "row", "left")
    return judged_rows.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``pages`` whose URL isn't blocked, with their columns."""
    host, path = host_and_path(F.col(url))
    names = [f"_{n}_" + "_".join(pages.columns) for n in ("host", "path")]
    keyed = pages.withColumns(dict(zip(names, (host, path), strict=True)))
    distinct = keyed.select(F.col(names[0]).alias("host"), F.col(names[1]).alias("path")).distinct()
    urls = distinct.withColumn("address", F.concat(F.lit("://"), "host", "path"))
    stop = judged(urls.withColumn("pair", F.struct("host", "path")), rules, "pair", "address", default).filter("verdict = 'block'")
    gone = stop.select(F.col("pair.host").alias(names[0]), F.col("pair.path").alias(names[1]))
    return salted_join(keyed, gone, names, "left_anti").select(*pages.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


SQL = """
WITH rules(rule_host, rule_path, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), rest AS (
  SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, r, regexp_extract(rest, '^[^/?#]*') AS given,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest
), named AS (
  SELECT page_id, r, translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), fitting AS (
  SELECT n.*, rule_host || rule_path AS rule, action, row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM named n LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fitting WHERE k = 1
"""
