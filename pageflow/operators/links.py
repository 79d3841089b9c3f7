"""Link extraction, link classification and the link graph.

Per-page work (extract, resolve, filter, de-duplicate) happens inside the page's own
row with array functions, so building the edge table needs no shuffle at all; only
the graph summary aggregates across pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.functions import html as H
from pageflow.functions import urls as U
from pageflow.operators.skew import salted_join

# Absolute http(s) link test of the thread-pool crawler family.
HTTP_URL = r"^http[s]*://.+"


def nav_links(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """H11 as a table: ``(page_id, host, pos, href)`` for every anchor with an href, and the page's
    ``keep`` columns (carried along, so that nothing has to be joined back)."""
    return pages.select(
        "page_id",
        U.url_netloc(url_col).alias("host"),
        *keep,
        F.posexplode(H.extract_hrefs(html_col)).alias("pos", "href"),
    )


def _first_per_key(items: Column) -> Column:
    """Keep the first (lowest pos) element per ``dst`` of an array<struct<dst,pos>>, inside the row."""
    s = F.array_sort(items)
    return F.filter(s, lambda x, i: (i == 0) | (x["dst"] != F.element_at(s, i)["dst"]))


def link_edges(pages: DataFrame, resolve: str = "page", assets: bool = True) -> DataFrame:
    """``(page_id, host, src, dst, pos)`` - distinct valid in-site links per page.

    Each href is normalized (U3) against the page URL (``resolve='page'``) or the site
    base (``resolve='base'``), filtered by U6, and de-duplicated per page keeping the
    first position (D1). No shuffle: everything is per row.
    """
    base = F.col("url") if resolve == "page" else U.site_base("url")
    page = F.struct(U.base_parts(base).alias("b"), U.url_netloc("url").alias("host"), H.extract_hrefs("html").alias("hrefs"))

    def per_page(pg: Column) -> Column:
        # page-level values (base parts, host) are evaluated once per page, not per link
        items = F.transform(pg["hrefs"], lambda h, i: F.struct(U.normalize_url(h, parts=pg["b"]).alias("dst"), i.alias("pos")))
        return _first_per_key(F.filter(items, lambda x: U.is_valid_url(x["dst"], pg["host"], assets)))

    return pages.select(
        "page_id",
        U.url_netloc("url").alias("host"),
        U.normalize_url("url").alias("src"),
        F.inline(U.let(page, per_page)),
    ).select("page_id", "host", "src", "dst", "pos")


def domain_links(pages: DataFrame, exclude: tuple[str, ...] = (), raw: bool = False) -> DataFrame:
    """U8: link classification of the thread-pool crawler family, per page.

    absolute ``http(s)://`` links are kept only on the same host (as written); ``/x`` joins
    the site base; ``#...`` and ``mailto:`` are dropped; anything else joins the page URL.
    Query and fragment are kept, trailing ``/`` stripped, ``exclude`` substrings removed,
    distinct per page. Joined links must be on the page's site too, so ``//other.com/x`` and ``tel:`` go;
    ``raw`` keeps them as that family does. Output ``(page_id, link)``.
    """
    page = F.struct(
        U.base_parts("url").alias("page"), U.base_parts(U.site_base("url")).alias("site"), U.url_netloc("url").alias("host"),
        F.regexp_extract("url", U.URL_SPLIT, 4).alias("query"), H.extract_hrefs("html").alias("hrefs"),
    )

    def per_page(pg: Column) -> Column:
        # what depends on the page alone is bound once, not per link
        def classify(h: Column) -> Column:
            rooted = h.startswith("/")
            joined = _join_keep_query(F.when(rooted, pg["site"]).otherwise(pg["page"]), F.when(rooted, F.lit("")).otherwise(pg["query"]), h)
            link = (
                F.when(h.rlike(HTTP_URL), F.when(U.url_netloc(h) == pg["host"], h))
                .when(h.startswith("#") | h.startswith("mailto:"), F.lit(None))
                .otherwise(joined)
            )
            return F.regexp_replace(link, r"/+$", "")

        links = F.transform(pg["hrefs"], classify)
        good = lambda x: x.isNotNull() & U.exclude_substrings(x, list(exclude))
        return F.array_distinct(F.filter(links, good if raw else lambda x: good(x) & (U.url_netloc(x) == pg["host"])))

    return pages.select("page_id", F.explode(U.let(page, per_page)).alias("link"))


def _join_keep_query(parts: Column, base_query: Column, ref: Column) -> Column:
    """``urljoin`` keeping the reference's query and fragment (params of the last segment kept too).
    A reference with a scheme of its own stays as it is written."""

    def joined(r: Column) -> Column:
        p = U.resolve_parts(None, r, parts=parts)
        raw_path = F.regexp_extract(r, U.URL_SPLIT, 3)
        params = F.regexp_extract(raw_path, r";([^/]*)$", 1)
        q = F.regexp_extract(r, U.URL_SPLIT, 4)
        has_q = r.rlike(r"^[^#]*\?")
        frag = F.regexp_extract(r, U.URL_SPLIT, 5)
        # an empty path in the reference inherits the base's query (urljoin rules)
        inherit_q = (raw_path == "") & ~has_q & (F.regexp_extract(r, U.URL_SPLIT, 2) == "")
        whole = U.let(p, lambda x: F.concat(
            x["scheme"], F.lit("://"), x["netloc"], x["path"],
            F.when(params != "", F.concat(F.lit(";"), params)).otherwise(F.lit("")),
            F.when(has_q & (q != ""), F.concat(F.lit("?"), q)).when(inherit_q & (base_query != ""), F.concat(F.lit("?"), base_query)).otherwise(F.lit("")),
            F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")),
        ))
        scheme = F.lower(F.regexp_extract(r, U.URL_SPLIT, 1))
        return F.when((scheme != "") & (scheme != parts["bs"]), r).otherwise(whole)

    return U.let(U._clean(ref), joined)


def graph_summary(edges: DataFrame, pages_keys: DataFrame) -> DataFrame:
    """K7: per page key: out-degree, in-degree, how many of its targets are dangling (absent from the
    snapshot), and how many it is the first to link to (``new_links``, by page_id and position; the
    others were seen before). ``edges(page_id, host, src, dst, pos)``, ``pages_keys(url)``.

    Each distinct edge emits an out-row for its source and an in-row for its target, each target one row
    for its first linker, and a single aggregate sums them. A target that every page links to is dealt
    over several tasks where edges meet the dangling targets.
    """
    e = edges.groupBy("host", "src", "dst").agg(F.min(F.struct("page_id", "pos")).alias("at"))
    known = pages_keys.select(F.col("url").alias("dst"))
    missing = e.select("dst").distinct().join(known.distinct(), "dst", "left_anti").withColumn("gone", F.lit(1))
    e = salted_join(e, missing, ["dst"], "left")
    zero, one = F.lit(0), F.lit(1)
    role = lambda url, o, i, d, n: F.struct(url.alias("url"), o.alias("o"), i.alias("i"), d.alias("d"), n.alias("n"))
    ends = F.array(role(F.col("src"), one, zero, F.coalesce("gone", zero), zero), role(F.col("dst"), zero, one, zero, zero))
    roles = e.select("host", F.inline(ends))
    first = edges.groupBy("host", "dst").agg(F.min_by("src", F.struct("page_id", "pos", "src")).alias("src"))
    roles = roles.unionAll(first.select("host", F.inline(F.array(role(F.col("src"), zero, zero, zero, one)))))
    return roles.groupBy("host", "url").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("d").alias("dangling"), F.sum("n").alias("new_links")
    )
