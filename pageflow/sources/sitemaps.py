"""Sitemap files of any size, read in splits.

A text scan cut at ``loc>`` gives the pieces of all documents, and the splits of one file go to several tasks. A piece is the
text of a URL, what lies between two of them, a head or a tail. A document whose pieces are all of these kinds, in the
right numbers and with one namespace prefix, is well-formed: its URLs are taken from their pieces. Any other one
(malformed, or with elements that aren't expected) is put together again from its pieces and read by the XML
parser as a whole, so that it gives what :func:`pageflow.sources.io.urls_from_sitemap` gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.functions.html import unescape_html
from pageflow.operators.routing import sitemap_guard
from pageflow.operators.skew import salted_join
from pageflow.sources.io import sitemap_namespace, urls_from_sitemap

CUT = "loc>"
_PREFIX = r"((?:[A-Za-z_][\w.-]*:)?)"
_LETTERS = "[^<&\\]\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]*+"
_TEXT = rf"{_LETTERS}(?:&(?:amp|lt|gt|quot|apos);{_LETTERS})*+"


def _others(group: int) -> str:
    """The elements beside loc that a url may have; fixed values. ``group`` is the number of their name's group."""
    return rf"\s*+(?:<\1(lastmod|changefreq|priority)>{_TEXT}</\1\{group}>\s*+)*+"


_OPENS = rf"(?s)^(?=.*<{_PREFIX}\z)"
_ATTRIBUTES = """(?:\\s+[\\w:.-]+\\s*=\\s*(?:"[^"<&]*"|'[^'<&]*'))*+"""
URL = rf"(?s)^{_TEXT}</{_PREFIX}\z"
BETWEEN = rf"{_OPENS}{_others(2)}</\1url>\s*+<\1url>{_others(3)}<\1\z"
HEAD = rf"{_OPENS}\s*+(?:<\?xml\s[^<>?]*\?>)?\s*+<\1urlset{_ATTRIBUTES}\s*>\s*+<\1url>{_others(2)}<\1\z"
TAIL = rf"(?s)^(?=.*</{_PREFIX}urlset>\s*\z){_others(2)}</\1url>\s*+</\1urlset>\s*\z"


def sitemap_pieces(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(doc, block, place, piece): the pieces of all files below ``path``. ``doc`` is the file's name, or the partition column
    ``key`` of the folder. (block, place) is the order inside a document."""
    text = spark.read.option("lineSep", CUT).text(path)
    doc = F.col(key) if key else F.col("_metadata.file_name")
    return text.select(doc.cast("string").alias("doc"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece"))


def _kind(piece: Column) -> Column:
    return F.when(piece.rlike(URL), "url").when(piece.rlike(BETWEEN), "between").when(piece.rlike(HEAD), "head").when(piece.rlike(TAIL), "tail").otherwise("other")


def urls_from_sitemap_files(spark: SparkSession, path: str, documents: DataFrame, key: str | None = None) -> DataFrame:
    """S4 + R5 over files: ``(host, url)``. ``documents`` has (doc, host, content_type), a row per file."""
    allowed = documents.filter(sitemap_guard("content_type")).select(F.col("doc").cast("string").alias("doc"), "host")
    pieces = sitemap_pieces(spark, path, key).withColumn("kind", _kind(F.col("piece")))
    prefix = F.when(F.col("kind") == "tail", F.regexp_extract("piece", TAIL, 1)).when(F.col("kind") == "url", F.regexp_extract("piece", URL, 1))
    prefix = F.coalesce(prefix, F.regexp_extract("piece", rf"<{_PREFIX}\z", 1))
    n = lambda k: F.count_if(F.col("kind") == k)
    whole = (n("head") == 1) & (n("tail") == 1) & (n("url") == n("between") + 1) & (n("other") == 0) & (F.min(prefix) == F.max(prefix))
    bound = F.max(F.when(F.col("kind") == "head", sitemap_namespace("piece")))
    verdict = pieces.groupBy("doc").agg((whole & F.coalesce(bound, F.lit(False))).alias("regular")).join(allowed, "doc")
    # a document may be most of the pieces: its verdict comes to them with salts
    regular = salted_join(pieces.filter("kind = 'url'"), verdict.filter("regular"), ["doc"])
    value = unescape_html(F.regexp_replace("piece", r"</[^<]*$", ""))
    urls = regular.select("host", F.btrim(value, F.lit(" \t\r\n")).alias("url"))
    rest = salted_join(pieces, verdict.filter("NOT regular"), ["doc"])
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "piece")))
    texts = rest.groupBy("doc", "host").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), CUT).alias("xml"))
    return urls.unionByName(urls_from_sitemap(texts.select("host", "xml", F.lit("xml").alias("content_type"))))
