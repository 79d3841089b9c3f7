"""Derived views over the driver's tables (the FIXTURES.md definitions), as Spark code.

Each view is derived from ``pages`` / ``documents`` / ``conversations`` / ``events`` /
``nation`` / ``region`` so its size grows with them. The same views exist as DuckDB CTEs
in :mod:`pageflow.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.functions import urls as U
from pageflow.operators.documents import METHODS
from pageflow.operators.links import nav_links as _nav_links
from pageflow.operators.ranking import rank_in_groups
from pageflow.sources.io import SITEMAP_NS

# File extensions of the ``files`` view, by page_id mod 8.
FILE_EXTS = [".pdf", ".csv", ".PNG", ".zip", ".tar.gz", ".xyz", ".mp3", ""]
# Fixed value: the sitemaps' chunk size (URLs are grouped by page_id div 1000).
SITEMAP_CHUNK = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(pages: DataFrame) -> DataFrame:
    """``(host, base_url)``: base = scheme://host of the host's lowest page_id."""
    return pages.groupBy(U.url_netloc("url").alias("host")).agg(F.min_by(U.site_base("url"), "page_id").alias("base_url"))


def nav_links(pages: DataFrame) -> DataFrame:
    return _nav_links(pages)


def page_refs(pages: DataFrame) -> DataFrame:
    """``(host, url)`` references seen from a site: its raw hrefs, the URL of the next page
    (page_id + 1) seen from this page's site (often a foreign link), and variants of page
    URLs that trip the exclusion rules."""
    host = U.url_netloc("url")
    raw = _nav_links(pages).select("host", F.col("href").alias("url"))
    here = pages.select((F.col("page_id") + 1).alias("next_id"), host.alias("host"))
    there = pages.select(F.col("page_id").alias("next_id"), "url")
    foreign = here.join(there, "next_id").select("host", "url")
    suffix = (
        F.when(F.col("page_id") % 7 == 0, F.lit("/login"))
        .when(F.col("page_id") % 7 == 1, F.lit("/author"))
        .when(F.col("page_id") % 7 == 2, F.lit(".css"))
        .when(F.col("page_id") % 7 == 3, F.lit("#x"))
        .when(F.col("page_id") % 7 == 4, F.lit("/"))
        .when(F.col("page_id") % 7 == 5, F.lit("?q=1"))
        .otherwise(F.lit(""))
    )
    variants = pages.select(host.alias("host"), F.concat(U.normalize_url("url"), suffix).alias("url"))
    return raw.unionByName(foreign).unionByName(variants)


def fetches(pages: DataFrame) -> DataFrame:
    """Pages with a synthetic response: status, content type and fetch time by page_id."""
    pid = F.col("page_id")
    status = F.when(pid % 20 == 7, 404).when(pid % 20 == 13, 500).otherwise(200).cast("int")
    ctype = (
        F.when(pid % 10 == 3, F.lit("application/pdf"))
        .when(pid % 10 == 5, F.lit("image/png"))
        .when(pid % 10 == 8, F.lit("Text/HTML; charset=utf-8"))
        .otherwise(F.lit("text/html"))
    )
    ts = F.timestamp_add("MINUTE", pid, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return pages.select("page_id", U.url_netloc("url").alias("host"), "url", "html", status.alias("status_code"),
                        ctype.alias("content_type"), ts.alias("fetch_ts"))


def with_headers(f: DataFrame) -> DataFrame:
    """Fetches with the response's headers as a map; every third response names no entity tag."""
    tag = F.when(F.col("page_id") % 3 != 0, F.map_from_arrays(F.array(F.lit("ETag")), F.array(F.md5("html"))))
    given = F.map_from_arrays(F.array(F.lit("Content-Type"), F.lit("Content-Length")), F.array(F.col("content_type"), F.octet_length("html").cast("string")))
    return f.withColumn("headers", F.map_concat(given, F.coalesce(tag, F.expr("CAST(map() AS map<string, string>)"))))


def responses(pages: DataFrame) -> DataFrame:
    """``fetches`` with every outcome: a sixth of the bodies repeated (also behind errors), bodies missing
    at page_id mod 50 = 9, blank ones at mod 31 = 4, and a third of the URLs files of the site."""
    pid = F.col("page_id")
    html = (
        F.when(pid % 50 == 9, F.lit(None).cast("string"))
        .when(pid % 31 == 4, F.lit("<html><body><div> </div></body></html>"))
        .when(pid % 6 == 1, F.concat(F.lit("<p>shared "), (pid % 4).cast("string"), F.lit("</p>")))
        .otherwise(F.col("html"))
    )
    file = F.concat(U.site_base("url"), F.lit("/f/doc"), pid.cast("string"), F.element_at(F.array(F.lit(".zip"), F.lit(".pdf"), F.lit(".csv")), (pid % 3 + 1).cast("int")))
    return fetches(pages).withColumn("html", html).withColumn("url", F.when(pid % 3 == 2, file).otherwise(F.col("url")))


def files(pages: DataFrame) -> DataFrame:
    """``(host, page_id, url)``: one downloadable-looking URL per page under its site base."""
    ext = F.element_at(F.array(*[F.lit(e) for e in FILE_EXTS]), (F.col("page_id") % 8 + 1).cast("int"))
    name = F.concat(F.lit("doc"), (F.col("page_id") % 5).cast("string"), ext)
    p = pages.select("page_id", U.url_netloc("url").alias("host"))
    return p.join(sites(pages), "host").select("host", "page_id", F.concat("base_url", F.lit("/f/"), name).alias("url"))


def robots(pages: DataFrame) -> DataFrame:
    """``(host, text)`` robots.txt per site; hosts of even name length spell ``sitemap:`` in
    lower case; hosts with length divisible by 3 use CRLF line ends."""
    s = sites(pages)
    nl = F.when(F.length("host") % 3 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    key = F.when(F.length("host") % 2 == 0, F.lit("sitemap:")).otherwise(F.lit("Sitemap:"))
    text = F.concat(F.lit("User-agent: *"), nl, F.lit("Disallow: /x"), nl, key, F.lit(" "), F.col("base_url"), F.lit("/sitemap.xml "), nl)
    return s.select("host", text.alias("text"))


def sitemaps(pages: DataFrame) -> DataFrame:
    """``(host, chunk, xml, content_type)``: urlset documents of a site's page URLs, one per
    page_id chunk (bounded size); host name length mod 6 = 0 -> truncated (malformed),
    = 1 -> served as text/plain, = 2 -> the namespace is bound to the prefix ``s``."""
    host = U.url_netloc("url")
    esc = F.replace(F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    entries = pages.select(host.alias("host"), F.floor(F.col("page_id") / SITEMAP_CHUNK).alias("chunk"), "page_id",
                           F.concat(F.lit("<url><loc> "), esc, F.lit(" </loc></url>")).alias("e"))
    grouped = entries.groupBy("host", "chunk").agg(F.sort_array(F.collect_list(F.struct("page_id", "e"))).alias("es"))
    body = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="{SITEMAP_NS}">'),
        F.array_join(F.transform("es", lambda x: x["e"]), ""),
        F.lit("</urlset>"),
    )
    prefixed = F.replace(F.regexp_replace(body, "<(/?)(urlset|url|loc)([ >])", "<$1s:$2$3"), F.lit(" xmlns="), F.lit(" xmlns:s="))
    body = F.when(F.length("host") % 6 == 2, prefixed).otherwise(body)
    bad = F.length("host") % 6 == 0
    xml = F.when(bad, F.regexp_replace(body, r"</loc></url></urlset>$", "</lo")).otherwise(body)
    ctype = F.when(F.length("host") % 6 == 1, F.lit("text/plain")).otherwise(F.lit("application/xml"))
    return grouped.select("host", "chunk", xml.alias("xml"), ctype.alias("content_type"))


def site_tree(pages: DataFrame) -> DataFrame:
    """``(page_id, host, src, dst, pos)``: pages of a site ranked by page_id; rank r links to 2r
    (pos 0) and 2r+1 (pos 1), and every rank > 1 links back to rank 1 (pos 2) - a
    binary tree with cycles. Keys are normalized URLs."""
    p = pages.select("page_id", U.url_netloc("url").alias("host"), U.normalize_url("url").alias("key"))
    r = rank_in_groups(p, ["host"], ["page_id"], "r")
    src = r.select("page_id", "host", F.col("r").alias("sr"), F.col("key").alias("src"))
    targets = src.select(
        "page_id", "host", "sr", "src",
        F.explode(F.array(
            F.struct((F.col("sr") * 2).alias("dr"), F.lit(0).alias("pos")),
            F.struct((F.col("sr") * 2 + 1).alias("dr"), F.lit(1).alias("pos")),
            F.struct(F.when(F.col("sr") > 1, F.lit(1)).alias("dr"), F.lit(2).alias("pos")),
        )).alias("t"),
    ).select("page_id", "host", "src", F.col("t.dr").alias("dr"), F.col("t.pos").alias("pos")).filter(F.col("dr").isNotNull())
    dst = r.select("host", F.col("r").alias("dr"), F.col("key").alias("dst"))
    # a rank belongs to one page, so no key is hot
    return targets.join(dst, ["host", "dr"]).select("page_id", "host", "src", "dst", F.col("pos").cast("int").alias("pos"))


def _crawl_file() -> F.Column:
    return F.concat(U.site_base("url"), F.lit("/f/doc"), (F.col("page_id") % 3).cast("string"), F.lit(".zip"))


def crawl_pages(pages: DataFrame) -> DataFrame:
    """The snapshot a crawl runs on: ``pages`` with a sixth of the bodies repeated, and a file per eighth page."""
    pid = F.col("page_id")
    html = F.when(pid % 6 == 4, F.concat(F.lit("same "), (pid % 2).cast("string"))).otherwise(F.col("html"))
    zips = pages.filter(pid % 8 == 3).select((pid + 10**12).alias("page_id"), _crawl_file().alias("url"), F.concat(F.lit("zip"), pid.cast("string")).alias("html"))
    return pages.select("page_id", "url", html.alias("html")).unionByName(zips)


def crawl_tree(pages: DataFrame) -> DataFrame:
    """``site_tree`` with a link to an absent page from every fourth page and to the file from every eighth."""
    pid, host, src = F.col("page_id"), U.url_netloc("url").alias("host"), U.normalize_url("url").alias("src")
    gone = pages.filter(pid % 4 == 1).select("page_id", host, src, F.concat(U.normalize_url("url"), F.lit("/missing")).alias("dst"), F.lit(3).alias("pos"))
    files_ = pages.filter(pid % 8 == 3).select("page_id", host, src, U.normalize_url(_crawl_file()).alias("dst"), F.lit(4).alias("pos"))
    return site_tree(pages).unionByName(gone).unionByName(files_)


def tree_seeds(pages: DataFrame) -> DataFrame:
    """``(host, url)``: the normalized key of each site's lowest page_id (rank 1 of site_tree)."""
    return pages.groupBy(U.url_netloc("url").alias("host")).agg(F.min_by(U.normalize_url("url"), "page_id").alias("url"))


def candidates(documents: DataFrame) -> DataFrame:
    """``(doc_id, method, method_rank, text)``: three extraction results per document:
    the text, the text with newlines as spaces (ties the first), and either the text
    plus its language (longer) or the text without spaces (shorter). A method is blank
    when doc_id mod 9 equals its rank; all are blank when doc_id mod 11 = 0."""
    d = documents.select("doc_id", "text", "lang")
    third = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" "), "lang")).otherwise(F.replace("text", F.lit(" "), F.lit("")))
    rows = d.select("doc_id", F.explode(F.array(
        F.struct(F.lit(1).alias("method_rank"), F.col("text").alias("t")),
        F.struct(F.lit(2).alias("method_rank"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("t")),
        F.struct(F.lit(3).alias("method_rank"), third.alias("t")),
    )).alias("c"))
    rank = F.col("c.method_rank")
    text = (
        F.when(F.col("doc_id") % 11 == 0, F.lit(" \n "))
        .when(F.col("doc_id") % 9 == rank, F.lit(""))
        .otherwise(F.col("c.t"))
    )
    method = F.element_at(F.array(*[F.lit(m) for m in METHODS]), rank)
    return rows.select("doc_id", method.alias("method"), rank.cast("int").alias("method_rank"), text.alias("text"))


def region_tables(nation: DataFrame, region: DataFrame) -> DataFrame:
    """``(r_regionkey, table_no, cells)``: table 0 = the region's nations as rows of
    [key, name, NULL] ordered by key; table 1 = an empty table (skipped when rendered)."""
    rows = nation.groupBy("n_regionkey").agg(
        F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns")
    )
    cells = F.transform("ns", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"], F.lit(None).cast("string")))
    t0 = region.join(rows, region.r_regionkey == rows.n_regionkey, "left").select(
        "r_regionkey", F.lit(0).alias("table_no"), F.coalesce(cells, F.array().cast("array<array<string>>")).alias("cells")
    )
    t1 = region.select("r_regionkey", F.lit(1).alias("table_no"), F.array().cast("array<array<string>>").alias("cells"))
    return t0.unionByName(t1)


def doc_tables(conversations: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """``(doc_id, page_no, table_no, cells)``: each conversation carries the tables of region
    ``conv_id mod 5`` on page (turn) ``conv_id mod 3``."""
    convs = conversations.select(F.col("conv_id").alias("doc_id")).distinct()
    t = region_tables(nation, region)
    return convs.join(t, (convs.doc_id % 5) == t.r_regionkey).select(
        "doc_id", (F.col("doc_id") % 3).alias("page_no"), "table_no", "cells"
    )


def parts(conversations: DataFrame) -> DataFrame:
    """``(doc_id, page_no, text)``: conversation turns as the pages of a document."""
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")


def attempts(events: DataFrame) -> DataFrame:
    """``(url, endpoint, ts, seq, ok, latency)``: request tries derived from events."""
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
        (F.col("event_id") % 7).alias("endpoint"),
        "ts",
        F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("value").alias("latency"),
    )


def visited(pages: DataFrame) -> DataFrame:
    """``(url)``: normalized keys of the previous run (even page_id)."""
    return pages.filter(F.col("page_id") % 2 == 0).select(U.normalize_url("url").alias("url")).distinct()


def crawled_and_batch(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The crawled table after run 0 (even page_id) and a run-1 batch of every page.
    ``(url, ts, status, batch_no)``; status 1 ok / 0 failed."""
    f = fetches(pages)
    key = U.normalize_url("url")
    crawled = f.filter(F.col("page_id") % 2 == 0).select(
        key.alias("url"), F.col("fetch_ts").alias("ts"), F.when(F.col("status_code") < 400, 1).otherwise(0).alias("status"),
        F.lit(0).alias("batch_no"),
    )
    batch = f.select(
        key.alias("url"), F.timestamp_add("DAY", F.lit(1), "fetch_ts").alias("ts"),
        F.when(F.col("page_id") % 3 == 0, 0).otherwise(1).alias("status"), F.lit(1).alias("batch_no"),
    )
    return crawled, batch
