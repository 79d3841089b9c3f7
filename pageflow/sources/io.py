"""Sources and sinks (S1-S8): page snapshots, downloaded files, robots/sitemaps, writers.

Writers cluster by site in a bounded number of files, never one file per page or site; every
writer returns the path it wrote so a job can read its own output back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.functions import urls as U
from pageflow.functions.html import strip_ws
from pageflow.operators.routing import sitemap_guard

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"

# Line boundaries of str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Sitemap XML shape (``urlset/url/loc``).
SITEMAP_SCHEMA = "url ARRAY<STRUCT<loc: STRING>>"
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page snapshot ``(page_id, url, html)`` (parquet); Catalyst prunes unused columns."""
    return spark.read.parquet(path)


def read_files(spark: SparkSession, path: str, glob: str | None = None, with_content: bool = False) -> DataFrame:
    """Downloaded files as ``(path, length, modificationTime[, content])``.

    Without ``with_content`` only metadata columns are selected, so file bodies are never
    read (the binary file source prunes ``content``).
    """
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.option("recursiveFileLookup", "true").load(path)
    cols = ["path", "length", "modificationTime"] + (["content"] if with_content else [])
    return df.select(*cols)


def sitemaps_from_robots(robots: DataFrame) -> DataFrame:
    """S3: ``(host, sitemap_url)``: every robots line starting (any case) with ``sitemap:``,
    text after the first colon, trimmed."""
    lines = robots.select("host", F.explode(F.split("text", LINE_BREAK)).alias("line"))
    return lines.filter(F.lower("line").startswith("sitemap:")).select(
        "host", strip_ws(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("sitemap_url")
    )


def sitemap_namespace(xml: str) -> Column:
    """Whether a document's ``urlset`` is in the sitemap namespace, whatever prefix that is bound to."""
    prefix = F.regexp_extract(xml, r"<(?:([A-Za-z_][\w.-]*):)?urlset[\s>]", 1)
    name = F.concat(F.lit("xmlns"), F.when(prefix != "", F.concat(F.lit(":"), prefix)).otherwise(F.lit("")))
    root = F.regexp_extract(xml, r"<(?:[A-Za-z_][\w.-]*:)?urlset(\s[^>]*)?>", 1)
    return F.contains(F.regexp_replace(root, r"\s*=\s*", "="), F.concat(name, F.lit('="' + SITEMAP_NS + '"')))


def urls_from_sitemap(sitemaps: DataFrame) -> DataFrame:
    """S4 + R5: ``(host, url)`` from ``urlset/url/loc`` (trimmed) of XML-typed responses, whatever prefix the
    sitemap namespace is bound to; a malformed document yields no rows; a sitemap index is not followed."""
    ok = sitemaps.filter(sitemap_guard("content_type") & sitemap_namespace("xml"))
    options = {"rowTag": "urlset", "mode": "PERMISSIVE", "ignoreNamespace": "true"}
    parsed = ok.select("host", F.from_xml("xml", SITEMAP_SCHEMA, options).alias("x"))
    return parsed.select("host", F.explode_outer("x.url").alias("u")).filter(F.col("u").isNotNull()).select(
        "host", F.trim(F.col("u.loc")).alias("url")
    ).filter(F.col("url").isNotNull())


def seed_frontier(sites: DataFrame, sitemap_urls: DataFrame, visited: DataFrame) -> DataFrame:
    """Start URL plus sitemap URLs (not domain-filtered), minus visited keys, distinct by key.

    Output ``(host, url)`` with ``url`` the normalized key.
    """
    starts = sites.select("host", F.col("base_url").alias("url"))
    both = starts.unionByName(sitemap_urls.select("host", "url"))
    keyed = both.select("host", U.normalize_url("url").alias("url")).distinct()
    return keyed.join(visited.select("url"), "url", "left_anti").select("host", "url")


def _clustered(df: DataFrame, files: int | None, *order: str) -> DataFrame:
    """``df`` in ``files`` parts (by default the session's shuffle partitions) that follow ``order``: a site's
    records lie together, a hot site is split, and the number of files doesn't grow with the number of sites."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def write_text(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> str:
    """Text records ``(host, key, text)`` as parquet, clustered by site (column statistics prune by host)."""
    _clustered(df.select("host", "key", "text"), files, "host", "key").write.mode(mode).parquet(path)
    return path


def write_metadata(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> str:
    """One JSON document per record (page or file metadata), clustered by site."""
    order = ["host", *[c for c in df.columns if c == "key"]]
    _clustered(df, files, *order).write.mode(mode).json(path)
    return path


def write_stats(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> str:
    """One stats JSON document per site."""
    _clustered(df, files, "host").write.mode(mode).json(path)
    return path
