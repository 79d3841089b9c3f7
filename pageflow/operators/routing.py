"""Routing and outcomes (U10, R1-R5); file names (U14) come from ``naming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.functions import html as H
from pageflow.functions import urls as U
from pageflow.functions.urls import ColumnOrName, _col
from pageflow.operators.dedup import content_hash, losers
from pageflow.operators.naming import assign_filenames  # noqa: F401


def content_route(status: ColumnOrName, ctype: ColumnOrName, url: ColumnOrName, mode: str = "strict") -> Column:
    """What a fetched response is treated as.

    ``strict`` (R1): 404 -> not_found, other >= 400 -> error, pdf by type or ``.pdf`` URL,
    ``text/html`` -> html, else unsupported (type lower-cased).
    ``permissive`` (R2): pdf by type only, everything else html.
    ``html_only`` (R3): ``text/html`` substring of the raw header -> html, else skipped.
    """
    status, ctype, url = _col(status), _col(ctype), _col(url)
    low = F.lower(F.coalesce(ctype, F.lit("")))
    if mode == "strict":
        return (
            F.when(status == 404, F.lit("not_found"))
            .when(status >= 400, F.lit("error"))
            .when(low.contains("application/pdf") | F.lower(url).endswith(".pdf"), F.lit("pdf"))
            .when(low.contains("text/html"), F.lit("html"))
            .otherwise(F.lit("unsupported"))
        )
    if mode == "permissive":
        return F.when(status >= 400, F.lit("error")).when(low.contains("application/pdf"), F.lit("pdf")).otherwise(F.lit("html"))
    if mode == "html_only":
        return F.when(status >= 400, F.lit("error")).when(F.coalesce(ctype, F.lit("")).contains("text/html"), F.lit("html")).otherwise(F.lit("skipped_non_html"))
    raise ValueError(f"unknown route mode {mode!r}")


def sitemap_guard(ctype: ColumnOrName) -> Column:
    """A sitemap response is parsed only when its lower-cased type contains ``xml``."""
    return F.lower(F.coalesce(_col(ctype), F.lit(""))).contains("xml")


def crawl_outcome(fetches: DataFrame, mode: str = "strict", html_as_page: bool = True, keep: tuple[str, ...] = ("page_id", "host", "url", "fetch_ts")) -> DataFrame:
    """``keep`` columns and the outcome class of each fetched URL.

    A failed request comes first, whatever was asked for; then the page-vs-file router (``.html``
    URLs are pages unless ``html_as_page`` is off); then the route of the response. Only
    HTML that is accepted (status, type, a page) counts for content duplicates, so an error page
    never makes a later page a duplicate; the first by ``page_id`` wins.

    Classes: not_found, error, downloaded, unsupported (strict) or skipped_non_html (html_only),
    parse_error (no body), duplicate, pdf_ok, pdf_empty, html_ok, html_empty.

    Route, blank flag and body hash are computed in the scan's projection; bodies are never shuffled. The flag is
    taken for accepted pages alone, and blocks are only followed where no block starts with text.
    """
    route = content_route("status_code", "content_type", "url", mode)
    file = U.route_url("url") == "file"
    if html_as_page:
        file = file & ~U.url_suffix("url").isin(".html", ".htm")
    asked = route.isin("html", "pdf") & ~file & F.col("html").isNotNull()
    narrow = fetches.select(*keep, route.alias("_route"), file.alias("_file"), F.col("html").isNull().alias("_none"), content_hash("html").alias("_hash"),
                            F.when(asked, H.without_block_text("html")).alias("_blank"))
    accepted = (F.col("_route") == "html") & ~F.col("_file") & ~F.col("_none")
    again = losers(narrow, F.when(accepted, F.col("_hash")), "page_id").withColumn("_again", F.lit(True))
    outcome = (
        F.when(F.col("_route").isin("not_found", "error"), F.col("_route"))
        .when(F.col("_file"), F.lit("downloaded"))
        .when(F.col("_route").isin("unsupported", "skipped_non_html"), F.col("_route"))
        .when(F.col("_none"), F.lit("parse_error"))
        .when(F.col("_again"), F.lit("duplicate"))
        .otherwise(F.concat(F.col("_route"), F.when(F.col("_blank"), F.lit("_empty")).otherwise(F.lit("_ok"))))
    )
    return narrow.join(again, "page_id", "left").select(*keep, outcome.alias("outcome"))
