"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

``QUERIES[name] = (build(spark, sf_dir) -> DataFrame, oracle SQL or None)``. Every
query reads the driver's tables (or views Spark derives from them) in full. Column
names and types are aligned with the oracle (integers as BIGINT, no structs/maps).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.functions import html as H
from pageflow.functions import urls as U
from pageflow.operators import crawl as K
from pageflow.operators import dedup as D
from pageflow.operators import documents as P
from pageflow.operators import links as L
from pageflow.operators import routing as R
from pageflow.operators import stats as T
from pageflow.plans import fixtures as X
from pageflow.plans import oracle as O
from pageflow.session import checkpoint_dir
from pageflow.sources import io as S
from pageflow.sources.sitemaps import urls_from_sitemap_files
from pageflow.sources.versioned import VersionedTable

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = (fn, sql)
        return fn

    return deco


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return X.table(spark, sf, name)


def _long(*cols: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in cols]


# ============================================================ S: sources
@register("page_scan", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_chars, md5(html) AS body_md5 FROM pages")
def q_page_scan(spark, sf):
    p = S.read_pages(spark, f"{sf}/pages.parquet")
    return p.select("page_id", "url", F.length("html").cast("long").alias("html_chars"), D.content_hash("html").alias("body_md5"))


_ROBOT_SITEMAPS_SQL = O.cte(sites=O.SITES, robots=O.ROBOTS) + (
    "SELECT host, " + O.strip_ws("regexp_extract(line, '^[^:]*:(.*)$', 1)") + " AS sitemap_url FROM "
    "(SELECT host, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')) AS line FROM robots) "
    "WHERE starts_with(lower(line), 'sitemap:')"
)


@register("robots_sitemaps", _ROBOT_SITEMAPS_SQL)
def q_robots_sitemaps(spark, sf):
    return S.sitemaps_from_robots(X.robots(t(spark, sf, "pages")))


# The oracle for sitemap parsing is independent of XML: the sitemaps are generated from
# pages, so the expected URLs are the pages of hosts whose sitemap is XML and well formed.
_SITEMAP_URLS_SQL = (
    f"SELECT {O.netloc('url')} AS host, url FROM pages WHERE length({O.netloc('url')}) % 6 NOT IN (0, 1)"
)


@register("sitemap_urls", _SITEMAP_URLS_SQL)
def q_sitemap_urls(spark, sf):
    return S.urls_from_sitemap(X.sitemaps(t(spark, sf, "pages")))


@register("sitemap_files", _SITEMAP_URLS_SQL)
def q_sitemap_files(spark, sf):
    """S4 over files that are read in splits: each sitemap is a file, found by its number."""
    out = _sink_dir(spark, "sitemaps")
    docs = X.sitemaps(t(spark, sf, "pages")).withColumn("doc", F.concat_ws("-", F.md5("host"), "chunk"))
    docs.select("doc", "xml").write.partitionBy("doc").text(out)
    return urls_from_sitemap_files(spark, out, docs.select("doc", "host", "content_type"), "doc")


_SEED_SQL = O.cte(sites=O.SITES, visited=O.VISITED) + (
    "SELECT DISTINCT host, key AS url FROM (SELECT host, " + O.normalize("u") + " AS key FROM ("
    "SELECT host, base_url AS u FROM sites UNION ALL "
    f"SELECT {O.netloc('url')} AS host, url AS u FROM pages WHERE length({O.netloc('url')}) % 6 NOT IN (0, 1))) "
    "WHERE key NOT IN (SELECT url FROM visited)"
)


@register("seed_frontier", _SEED_SQL)
def q_seed_frontier(spark, sf):
    pages = t(spark, sf, "pages")
    return S.seed_frontier(X.sites(pages), S.urls_from_sitemap(X.sitemaps(pages)), X.visited(pages))


# ============================================================ U: URL functions
_PARTS_SQL = (
    f"SELECT page_id, {O.scheme('url')} AS scheme, {O.netloc('url')} AS netloc, {O.path('url')} AS path, "
    f"CASE WHEN {O._in(O.scheme('url'), O.USES_PARAMS)} THEN regexp_extract({O.raw_path('url')}, ';([^/]*)$', 1) ELSE '' END AS params, "
    f"{O.query('url')} AS query, {O.fragment('url')} AS fragment FROM pages"
)


@register("url_parts", _PARTS_SQL)
def q_url_parts(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.url_parts("url").alias("p")).select("page_id", "p.*")


@register("url_resolve", O.cte(nav_links=O.NAV_LINKS) + (
    f"SELECT n.page_id, CAST(n.pos AS BIGINT) AS pos, {O.resolve('p.url', 'n.href')} AS resolved, "
    f"{O.resolve(O.site_base('p.url'), 'n.href')} AS resolved_base FROM nav_links n JOIN pages p ON p.page_id = n.page_id"))
def q_url_resolve(spark, sf):
    n = L.nav_links(t(spark, sf, "pages"), keep=("url",))
    return n.select("page_id", F.col("pos").cast("long").alias("pos"), U.resolve_url("url", "href").alias("resolved"),
                    U.resolve_url(U.site_base("url"), "href").alias("resolved_base"))


@register("url_normalize", f"SELECT page_id, {O.normalize('url')} AS key_whole, {O.normalize('url', mode='path')} AS key_path FROM pages")
def q_url_normalize(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.normalize_url("url").alias("key_whole"), U.normalize_url("url", mode="path").alias("key_path"))


_REFS = O.cte(nav_links=O.NAV_LINKS, page_refs=O.PAGE_REFS)


@register("same_site", _REFS + (
    f"SELECT host, url, {O.netloc('url')} = host AS strict_site, ({O.netloc('url')} = '' OR {O.netloc('url')} = host) AS lenient_site FROM page_refs"))
def q_same_site(spark, sf):
    r = X.page_refs(t(spark, sf, "pages"))
    return r.select("host", "url", U.same_site("url", "host", strict=True).alias("strict_site"), U.same_site("url", "host").alias("lenient_site"))


@register("valid_urls", _REFS + (
    f"SELECT host, url, {O.is_valid(O.normalize('url', O.site_base('url')), 'host')} AS valid_three, "
    f"{O.is_valid('url', 'host', assets=False)} AS valid_two FROM page_refs"))
def q_valid_urls(spark, sf):
    r = X.page_refs(t(spark, sf, "pages"))
    return r.select("host", "url", U.is_valid_url(U.normalize_url("url", U.site_base("url")), "host").alias("valid_three"),
                    U.is_valid_url("url", "host", assets=False).alias("valid_two"))


@register("exclude_substrings", _REFS + "SELECT host, url FROM page_refs WHERE NOT contains(url, '/login') AND NOT contains(url, '.css')")
def q_exclude_substrings(spark, sf):
    r = X.page_refs(t(spark, sf, "pages"))
    return r.filter(U.exclude_substrings("url", ["/login", ".css"]))


# Links that the families treat differently, in front of real pages.
_ODD_LINKS = ('<a href="//other.com/x">a</a><a href="tel:123">b</a><a href="javascript:void(0)">c</a><a href="mailto:a@b">d</a>'
              '<a href="#t">e</a><a href="sub/p;v=1?q=1#f">f</a><a href="?only=query">g</a>')


def _domain_links_sql(raw: bool) -> str:
    # family-A classification over each page's hrefs, distinct per page
    host = O.netloc("url")
    base = O.site_base("url")

    def join_keep(b: str, r: str) -> str:
        rp = O.raw_path(r)
        params = f"regexp_extract({rp}, ';([^/]*)$', 1)"
        q = O.query(r)
        has_q = f"regexp_matches({r}, '^[^#]*\\?')"
        frag = O.fragment(r)
        inherit = f"({rp} = '' AND NOT {has_q} AND {O.netloc(r)} = '')"
        bq = O.query(b)
        return (f"(CASE WHEN {O.scheme(r)} <> '' AND {O.scheme(r)} <> {O.scheme(b)} THEN {r} ELSE {O.resolve(b, r)} || CASE WHEN {params} <> '' THEN ';' || {params} ELSE '' END || "
                f"CASE WHEN {has_q} AND {q} <> '' THEN '?' || {q} WHEN {inherit} AND {bq} <> '' THEN '?' || {bq} ELSE '' END || "
                f"CASE WHEN contains({r}, '#') AND {frag} <> '' THEN '#' || {frag} ELSE '' END END)")

    cls = (f"CASE WHEN regexp_matches(h, '^http[s]*://.+') THEN CASE WHEN {O.netloc('h')} = host THEN h END "
           f"WHEN starts_with(h, '/') THEN {join_keep('base', 'h')} "
           "WHEN starts_with(h, '#') OR starts_with(h, 'mailto:') THEN NULL "
           f"ELSE {join_keep('url', 'h')} END")
    here = "" if raw else f" AND {O.netloc('link')} = host"
    return (
        f"SELECT DISTINCT page_id, link FROM (SELECT page_id, host, regexp_replace({cls}, '/+$', '') AS link FROM "
        f"(SELECT page_id, url, {host} AS host, {base} AS base, unnest({O.hrefs('html')}) AS h FROM "
        f"(SELECT page_id, url, {O.lit(_ODD_LINKS)} || html AS html FROM pages))) WHERE link IS NOT NULL{here}"
    )


def _odd_pages(spark, sf):
    return t(spark, sf, "pages").select("page_id", "url", F.concat(F.lit(_ODD_LINKS), "html").alias("html"))


@register("domain_links", _domain_links_sql(False))
def q_domain_links(spark, sf):
    return L.domain_links(_odd_pages(spark, sf))


@register("domain_links_raw", _domain_links_sql(True))
def q_domain_links_raw(spark, sf):
    return L.domain_links(_odd_pages(spark, sf), raw=True)


_FILES = O.cte(sites=O.SITES, files=O.FILES)


@register("file_categories", _FILES + (
    f"SELECT url, {O.category('url')} AS category, {O.category('url', 'narrow')} AS category_narrow, "
    f"{O.category('url', mode='raw')} AS category_raw FROM (SELECT url FROM files UNION ALL SELECT url FROM pages)"))
def q_file_categories(spark, sf):
    pages = t(spark, sf, "pages")
    u = X.files(pages).select("url").unionByName(pages.select("url"))
    return u.select("url", U.file_category("url").alias("category"), U.file_category("url", "narrow").alias("category_narrow"),
                    U.file_category("url", mode="raw").alias("category_raw"))


@register("route_urls", _FILES + (
    f"SELECT url, CASE WHEN {O.category('url')} IS NOT NULL THEN 'file' ELSE 'page' END AS route, count(*) AS n "
    "FROM (SELECT url FROM files UNION ALL SELECT url FROM pages) GROUP BY 1, 2"))
def q_route_urls(spark, sf):
    pages = t(spark, sf, "pages")
    u = X.files(pages).select("url").unionByName(pages.select("url"))
    return u.groupBy("url", U.route_url("url").alias("route")).agg(F.count("*").alias("n"))


@register("url_keys", "SELECT page_id, md5(url) AS url_hash, md5(url) || '.txt' AS text_key, md5(url) || '.json' AS meta_key, "
          "md5(url) || '_pdf.txt' AS pdf_key, md5(url) || '_file.json' AS file_key FROM pages")
def q_url_keys(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.url_key("url").alias("url_hash"), U.url_key("url", ".txt").alias("text_key"),
                                        U.url_key("url", ".json").alias("meta_key"), U.url_key("url", "_pdf.txt").alias("pdf_key"),
                                        U.url_key("url", "_file.json").alias("file_key"))


@register("sanitize_names", (
    "SELECT page_id, regexp_replace(regexp_replace(substr(url, 1, 50), '[^-_.() A-Za-z0-9]', '', 'g') || '_' || md5(url), '\\.+$', '') AS short_name, "
    "CASE WHEN length(n) > 200 THEN substr(n, 1, 150) || '_' || substr(md5(url), 1, 10) ELSE n END AS long_name "
    "FROM (SELECT page_id, url, regexp_replace(url, '[^\\p{L}\\p{N}_\\-.]', '_', 'g') AS n FROM pages)"))
def q_sanitize_names(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.sanitize_filename("url").alias("short_name"), U.sanitize_filename("url", "long").alias("long_name"))


@register("assign_filenames", _FILES + (
    "SELECT host, page_id, url, category, CASE WHEN k = 0 THEN name ELSE stem || '_' || CAST(k AS VARCHAR) || ext END AS filename FROM ("
    "SELECT *, CAST(row_number() OVER (PARTITION BY host, category, name ORDER BY page_id) - 1 AS BIGINT) AS k, "
    "substr(name, 1, length(name) - length(ext)) AS stem FROM ("
    f"SELECT *, regexp_extract(name, '[^.](\\.[^.]*)$', 1) AS ext FROM (SELECT host, page_id, url, {O.category('url')} AS category, "
    f"CASE WHEN regexp_extract({O.path('url')}, '([^/]*)$', 1) = '' THEN md5(url) || '.unknown' ELSE regexp_extract({O.path('url')}, '([^/]*)$', 1) END AS name "
    "FROM files)))"))
def q_assign_filenames(spark, sf):
    f = X.files(t(spark, sf, "pages")).withColumn("category", U.file_category("url"))
    return R.assign_filenames(f, "page_id").select("host", "page_id", "url", "category", "filename")


# ============================================================ H: HTML
@register("strip_elements", f"SELECT page_id, md5({O.strip_elements('html')}) AS body_md5, "
          f"CAST(length({O.strip_elements('html', ('script', 'style', 'noscript'))}) AS BIGINT) AS chars_noscript FROM pages")
def q_strip_elements(spark, sf):
    return t(spark, sf, "pages").select("page_id", D.content_hash(H.strip_elements("html")).alias("body_md5"),
                                        F.length(H.strip_elements("html", H.DROP_WITH_NOSCRIPT)).cast("long").alias("chars_noscript"))


@register("page_title", f"SELECT page_id, {O.title('html')} AS title FROM pages")
def q_page_title(spark, sf):
    return t(spark, sf, "pages").select("page_id", H.page_title("html").alias("title"))


@register("page_text", f"SELECT page_id, {O.page_text('html')} AS text FROM pages")
def q_page_text(spark, sf):
    return t(spark, sf, "pages").select("page_id", H.page_text("html").alias("text"))


@register("block_text", f"SELECT page_id, {O.block_text('html')} AS text FROM pages")
def q_block_text(spark, sf):
    return t(spark, sf, "pages").select("page_id", H.block_text("html").alias("text"))


# Real pages inside a list item, with an inner list and unclosed items around them.
_NEST = ("<ul><li>top<div><section>", "</section></div><ul><li>sub</li></ul>tail</li><li>next<p>last</ul>")


@register("block_text_nested", f"SELECT page_id, {O.block_text(chr(40) + O.lit(_NEST[0]) + ' || html || ' + O.lit(_NEST[1]) + chr(41))} AS text FROM pages")
def q_block_text_nested(spark, sf):
    """H4 over blocks in blocks."""
    nested = F.concat(F.lit(_NEST[0]), "html", F.lit(_NEST[1]))
    return t(spark, sf, "pages").select("page_id", H.block_text(nested).alias("text"))


# Anchors in comments and scripts, quoted '>' and references around the links of real pages.
_SNIPPETS = ("<!-- <a href=\"/old\"> --><script>'<a href=\"/js\">'</script><title lang=\"a>b\">&eacute;t&#233; &notin; &#146;</title>"
             "<a title=\"a > b\" href=\"/quoted\">x</a><img alt=\"c > d\">", "<a href=/bare>y</a><script>open()")


def _wrapped_sql(what: str) -> str:
    return f"SELECT page_id, {what} FROM (SELECT page_id, {O.lit(_SNIPPETS[0])} || html || {O.lit(_SNIPPETS[1])} AS html FROM pages)"


@register("wrapped_pages", _wrapped_sql(f"array_to_string({O.hrefs('html')}, ' ') AS links, {O.title('html')} AS title, {O.page_text('html')} AS text"))
def q_wrapped_pages(spark, sf):
    """H2, H3 and H11 over pages with commented, scripted and quoted markup."""
    html = F.concat(F.lit(_SNIPPETS[0]), "html", F.lit(_SNIPPETS[1]))
    p = t(spark, sf, "pages").select("page_id", html.alias("html"))
    return p.select("page_id", F.array_join(H.extract_hrefs("html"), " ").alias("links"), H.page_title("html").alias("title"), H.page_text("html").alias("text"))


@register("unquote", f"SELECT page_id, url_decode({O.path('url')}) AS path FROM (SELECT page_id, replace(url, '%', '%25') || '%20%C3%A9%2F' AS url FROM pages)")
def q_unquote(spark, sf):
    """U15 over page paths with escapes added."""
    url = F.concat(F.replace(F.col("url"), F.lit("%"), F.lit("%25")), F.lit("%20%C3%A9%2F"))
    p = t(spark, sf, "pages").select("page_id", url.alias("url"))
    return p.select("page_id", U.unquote(U.url_path("url")).alias("path"))


@register("visible_text", f"SELECT page_id, {O.visible_text('html')} AS text FROM pages")
def q_visible_text(spark, sf):
    return t(spark, sf, "pages").select("page_id", H.visible_text("html").alias("text"))


@register("line_text", f"SELECT page_id, 'URL: ' || url || chr(10) || chr(10) || {O.page_text('html', chr(10), ('script', 'style', 'meta', 'link'))} AS text FROM pages")
def q_line_text(spark, sf):
    p = t(spark, sf, "pages")
    return p.select("page_id", H.with_source(H.line_text("html"), "url", style="plain").alias("text"))


@register("alt_text", f"SELECT page_id, {O.clean(O.page_text('html'))} AS text FROM pages")
def q_alt_text(spark, sf):
    return t(spark, sf, "pages").select("page_id", H.alt_text("html").alias("text"))


@register("clean_documents", f"SELECT doc_id, {O.clean('text')} AS text FROM documents")
def q_clean_documents(spark, sf):
    return t(spark, sf, "documents").select("doc_id", H.clean_text("text").alias("text"))


_FALLBACK_SQL = (
    f"SELECT page_id, coalesce(nullif({O.block_text('html')}, ''), nullif({O.clean(O.page_text('html'))}, ''), '') AS text FROM pages"
)


@register("text_or_alternative", _FALLBACK_SQL)
def q_text_or_alternative(spark, sf):
    return t(spark, sf, "pages").select("page_id", H.text_or_alternative("html").alias("text"))


@register("with_source", (
    "SELECT page_id, '[Source](' || url || ')' || chr(10) || chr(10) || body AS text, "
    f"{O.clean(chr(39) + '[Source](' + chr(39) + ' || url || ' + chr(39) + ')' + chr(39) + ' || chr(10) || chr(10) || body')} AS text_compat FROM ("
    f"SELECT page_id, url, coalesce(nullif({O.visible_text('html')}, ''), nullif({O.clean(O.page_text('html'))}, ''), '') AS body FROM pages)"))
def q_with_source(spark, sf):
    p = t(spark, sf, "pages")
    body = F.coalesce(F.nullif(H.visible_text("html"), F.lit("")), F.nullif(H.alt_text("html"), F.lit("")), F.lit(""))
    b = p.select("page_id", "url", body.alias("body"))
    return b.select("page_id", H.with_source("body", "url").alias("text"), H.with_source("body", "url", compat=True).alias("text_compat"))


@register("nav_links", O.cte(nav_links=O.NAV_LINKS) + "SELECT page_id, host, CAST(pos AS BIGINT) AS pos, href FROM nav_links")
def q_nav_links(spark, sf):
    return L.nav_links(t(spark, sf, "pages")).select("page_id", "host", F.col("pos").cast("long").alias("pos"), "href")


_EDGES_BODY = (
    "SELECT page_id, host, src, dst, CAST(min(pos) AS BIGINT) AS pos FROM ("
    f"SELECT n.page_id, n.host, {O.normalize('p.url')} AS src, {O.normalize('n.href', 'p.url')} AS dst, n.pos "
    "FROM nav_links n JOIN pages p ON p.page_id = n.page_id) "
    f"WHERE {O.is_valid('dst', 'host')} GROUP BY page_id, host, src, dst"
)
_EDGES_SQL = O.cte(nav_links=O.NAV_LINKS) + _EDGES_BODY


@register("link_edges", _EDGES_SQL)
def q_link_edges(spark, sf):
    e = L.link_edges(t(spark, sf, "pages"))
    return e.select("page_id", "host", "src", "dst", F.col("pos").cast("long").alias("pos"))


@register("unescape_titles", "SELECT page_id, " + O.unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)") + " AS title_text FROM pages")
def q_unescape_titles(spark, sf):
    return t(spark, sf, "pages").select("page_id", H.unescape_html(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)).alias("title_text"))


_RECORDS_SQL = O.cte(fetches=O.FETCHES) + (
    f"SELECT page_id, url, {O.title('html')} AS title, epoch(fetch_ts) AS timestamp, {O.HEADERS} AS headers, status_code, content_type, "
    f"{O.page_text('html')} AS content, md5(url) || '.txt' AS text_key FROM fetches WHERE status_code < 400 AND contains(content_type, 'text/html')"
)


@register("page_records", _RECORDS_SQL)
def q_page_records(spark, sf):
    """H14; the map of headers as one JSON document."""
    f = X.with_headers(X.fetches(t(spark, sf, "pages"))).filter((F.col("status_code") < 400) & F.col("content_type").contains("text/html"))
    record = {k: c.alias(k) for k, c in P.page_record().items()} | {"headers": F.to_json("headers").alias("headers")}
    return f.select("page_id", "content_type", *record.values())


# ============================================================ P: documents
_CANDS = O.cte(candidates=O.CANDIDATES)


@register("best_candidate", _CANDS + (
    "SELECT d.doc_id, coalesce(b.text, '') AS text, coalesce(b.method, '') AS method FROM (SELECT DISTINCT doc_id FROM candidates) d "
    "LEFT JOIN (SELECT doc_id, arg_max(text, n * 10 - method_rank) AS text, arg_max(method, n * 10 - method_rank) AS method FROM ("
    f"SELECT *, length({O.strip_ws('text')}) AS n FROM candidates) WHERE n > 0 GROUP BY doc_id) b ON b.doc_id = d.doc_id"))
def q_best_candidate(spark, sf):
    return P.best_candidate(X.candidates(t(spark, sf, "documents")))


@register("assemble_parts", (
    "SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text_keep, "
    "coalesce(string_agg(CASE WHEN text <> '' THEN text END, chr(10) ORDER BY turn), '') AS text_drop FROM conversations GROUP BY conv_id"))
def q_assemble_parts(spark, sf):
    parts = X.parts(t(spark, sf, "conversations"))
    keep = P.assemble_parts(parts, "keep").withColumnRenamed("text", "text_keep")
    drop = P.assemble_parts(parts, "drop").withColumnRenamed("text", "text_drop")
    return keep.join(drop, "doc_id", "left").select("doc_id", "text_keep", F.coalesce("text_drop", F.lit("")).alias("text_drop"))


@register("render_tables", O.cte(region_tables=O.REGION_TABLES) + (
    "SELECT r_regionkey, CAST(table_no AS BIGINT) AS table_no, CASE WHEN len(cells) > 0 THEN chr(10) || '**Tableau:**' || chr(10) || "
    "array_to_string(list_transform(cells, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), chr(9))), chr(10)) || chr(10) END AS rendered "
    "FROM region_tables"))
def q_render_tables(spark, sf):
    rt = X.region_tables(t(spark, sf, "nation"), t(spark, sf, "region"))
    return rt.select("r_regionkey", F.col("table_no").cast("long").alias("table_no"), P.render_table("cells").alias("rendered"))


_RENDER = ("CASE WHEN len(cells) > 0 THEN chr(10) || '**Tableau:**' || chr(10) || array_to_string(list_transform(cells, lambda r: "
           "array_to_string(list_transform(r, lambda c: coalesce(c, '')), chr(9))), chr(10)) || chr(10) END")


@register("assemble_document", O.cte(region_tables=O.REGION_TABLES, doc_tables=O.DOC_TABLES, parts=O.PARTS) + (
    "SELECT doc_id, string_agg(chunk, '' ORDER BY page_no) AS text FROM ("
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page_no, b.page_no) AS page_no, "
    "coalesce(a.page_text, '') || coalesce(b.tables_text, '') AS chunk FROM "
    "(SELECT doc_id, page_no, CASE WHEN coalesce(text, '') <> '' THEN text || chr(10) ELSE '' END AS page_text FROM parts) a FULL JOIN "
    f"(SELECT doc_id, page_no, string_agg(t, '' ORDER BY table_no) AS tables_text FROM (SELECT doc_id, page_no, table_no, {_RENDER} AS t FROM doc_tables) "
    "WHERE t IS NOT NULL GROUP BY 1, 2) b ON a.doc_id = b.doc_id AND a.page_no = b.page_no) GROUP BY doc_id"))
def q_assemble_document(spark, sf):
    conv = t(spark, sf, "conversations")
    return P.assemble_document(X.parts(conv), X.doc_tables(conv, t(spark, sf, "nation"), t(spark, sf, "region")))


_BEST_SQL_CTE = (
    "SELECT d.doc_id, coalesce(b.text, '') AS text, coalesce(b.method, '') AS method FROM (SELECT DISTINCT doc_id FROM candidates) d "
    "LEFT JOIN (SELECT doc_id, arg_max(text, n * 10 - method_rank) AS text, arg_max(method, n * 10 - method_rank) AS method FROM ("
    f"SELECT *, length({O.strip_ws('text')}) AS n FROM candidates) WHERE n > 0 GROUP BY doc_id) b ON b.doc_id = d.doc_id"
)


@register("extraction_report", O.cte(candidates=O.CANDIDATES, best=_BEST_SQL_CTE) + (
    f"SELECT CAST(count(*) FILTER (WHERE length({O.strip_ws('text')}) > 0) AS BIGINT) AS processed, "
    f"CAST(count(*) FILTER (WHERE length({O.strip_ws('text')}) = 0) AS BIGINT) AS failed, "
    f"CAST(coalesce(sum(length(text)) FILTER (WHERE length({O.strip_ws('text')}) > 0), 0) AS BIGINT) AS text_length, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE length({O.strip_ws('text')}) > 0 AND method = '{m}') AS BIGINT) AS method_{m}" for m in X.METHODS)
    + " FROM best"))
def q_extraction_report(spark, sf):
    return P.extraction_report(P.best_candidate(X.candidates(t(spark, sf, "documents"))))


@register("extraction_records", O.cte(candidates=O.CANDIDATES, best=_BEST_SQL_CTE) + (
    "SELECT doc_id, url, method AS extraction_method, md5(url) || '_pdf.txt' AS text_file, CAST(length(text) AS BIGINT) AS text_length FROM ("
    f"SELECT b.*, 'https://' || d.source || '.example/' || CAST(d.doc_id AS VARCHAR) || '.pdf' AS url FROM best b JOIN documents d USING (doc_id)) WHERE length({O.strip_ws('text')}) > 0"))
def q_extraction_records(spark, sf):
    """P5: the record of each document that gave text."""
    docs = t(spark, sf, "documents")
    urls = docs.select("doc_id", F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("url"))
    return P.extraction_records(P.best_candidate(X.candidates(docs)), urls)


# ============================================================ R: routing
_FETCH = O.cte(fetches=O.FETCHES)


@register("content_routes", _FETCH + (
    "SELECT page_id, CASE WHEN status_code = 404 THEN 'not_found' WHEN status_code >= 400 THEN 'error' "
    "WHEN contains(lower(content_type), 'application/pdf') OR ends_with(lower(url), '.pdf') THEN 'pdf' "
    "WHEN contains(lower(content_type), 'text/html') THEN 'html' ELSE 'unsupported' END AS route_strict, "
    "CASE WHEN status_code >= 400 THEN 'error' WHEN contains(lower(content_type), 'application/pdf') THEN 'pdf' ELSE 'html' END AS route_permissive, "
    "CASE WHEN status_code >= 400 THEN 'error' WHEN contains(content_type, 'text/html') THEN 'html' ELSE 'skipped_non_html' END AS route_html_only "
    "FROM fetches"))
def q_content_routes(spark, sf):
    f = X.fetches(t(spark, sf, "pages"))
    return f.select("page_id", R.content_route("status_code", "content_type", "url").alias("route_strict"),
                    R.content_route("status_code", "content_type", "url", "permissive").alias("route_permissive"),
                    R.content_route("status_code", "content_type", "url", "html_only").alias("route_html_only"))


_RESP = O.cte(fetches=O.FETCHES, responses=O.RESPONSES)


def _outcomes(spark, sf, mode="strict"):
    return R.crawl_outcome(X.responses(t(spark, sf, "pages")), mode)


@register("crawl_outcomes", _RESP + f"SELECT page_id, host, url, outcome FROM ({O.outcome('strict')})")
def q_crawl_outcomes(spark, sf):
    return _outcomes(spark, sf).select("page_id", "host", "url", "outcome")


@register("crawl_outcomes_html_only", _RESP + f"SELECT page_id, outcome FROM ({O.outcome('html_only')})")
def q_crawl_outcomes_html_only(spark, sf):
    """R4 of the family that takes nothing but HTML."""
    return _outcomes(spark, sf, "html_only").select("page_id", "outcome")


# ============================================================ D: de-dup and state
@register("dedup_content", "SELECT doc_id, lang, source FROM (SELECT *, min(doc_id) OVER (PARTITION BY md5(text)) AS w FROM documents) WHERE doc_id = w")
def q_dedup_content(spark, sf):
    return D.dedup_content(t(spark, sf, "documents"), "text", "doc_id").select("doc_id", "lang", "source")


@register("dedup_urls", f"SELECT page_id, url FROM (SELECT *, min(page_id) OVER (PARTITION BY {O.normalize('url')}) AS w FROM pages) WHERE page_id = w")
def q_dedup_urls(spark, sf):
    return D.dedup_urls(t(spark, sf, "pages").select("page_id", "url"), "url", "page_id")


_TREE = O.cte(site_tree=O.SITE_TREE, tree_seeds=O.TREE_SEEDS)


@register("unseen_links", _TREE + (
    "SELECT DISTINCT e.host, e.dst AS url FROM site_tree e "
    "WHERE NOT EXISTS (SELECT 1 FROM tree_seeds z WHERE z.host = e.host AND z.url = e.dst)"))
def q_unseen_links(spark, sf):
    pages = t(spark, sf, "pages")
    seeds = X.tree_seeds(pages)
    links = X.site_tree(pages).select("host", F.col("dst").alias("url"))
    return D.unseen(links, seeds, ["host", "url"]).distinct()


_VIS = O.cte(visited=O.VISITED)


@register("visited_filter", _VIS + (
    f"SELECT page_id, url, {O.normalize('url')} IN (SELECT url FROM visited) AS was_visited FROM pages"))
def q_visited_filter(spark, sf):
    pages = t(spark, sf, "pages").select("page_id", "url")
    v = X.visited(t(spark, sf, "pages"))
    unv = D.filter_visited(pages, v, keep="unvisited").withColumn("was_visited", F.lit(False))
    vis = D.filter_visited(pages, v, keep="visited").withColumn("was_visited", F.lit(True))
    return unv.unionByName(vis)


@register("visited_filter_bloom", QUERIES["visited_filter"][1])
def q_visited_filter_bloom(spark, sf):
    """D3 against a table in buckets with Bloom filters: only keys that may be there are joined with it."""
    pages = t(spark, sf, "pages")
    table = VersionedTable(spark, f"{checkpoint_dir(spark).rstrip('/')}/visited-{uuid.uuid4().hex}", "url string", ["url"], buckets=16, filters=True)
    table.merge(X.visited(pages), 0)
    asked = pages.select("page_id", F.col("url").alias("given"), U.normalize_url("url").alias("url"))
    both = table.lacking(asked).withColumn("was_visited", F.lit(False)).unionByName(table.having(asked).withColumn("was_visited", F.lit(True)))
    return both.select("page_id", F.col("given").alias("url"), "was_visited")


@register("mark_visited", _VIS + f"SELECT url FROM visited UNION SELECT {O.normalize('url')} FROM pages")
def q_mark_visited(spark, sf):
    pages = t(spark, sf, "pages")
    return D.mark_visited(X.visited(pages), pages)


@register("upsert_crawled", (
    f"SELECT url, arg_max(status, batch_no * 10000000000 + page_id * 10 + status) AS status, CAST(max(batch_no) AS BIGINT) AS batch_no FROM ("
    f"SELECT {O.normalize('url')} AS url, page_id, CASE WHEN page_id % 20 IN (7, 13) THEN 0 ELSE 1 END AS status, 0 AS batch_no FROM pages WHERE page_id % 2 = 0 "
    f"UNION ALL SELECT {O.normalize('url')} AS url, page_id, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS status, 1 AS batch_no FROM pages) "
    "GROUP BY url"))
def q_upsert_crawled(spark, sf):
    crawled, batch = X.crawled_and_batch(t(spark, sf, "pages"))
    u = D.upsert_crawled(crawled, batch)
    return u.select("url", F.col("status").cast("int").alias("status"), F.col("batch_no").cast("long").alias("batch_no"))


@register("resume_run", _VIS + (
    f"SELECT DISTINCT {O.normalize('url')} AS url FROM pages WHERE {O.normalize('url')} NOT IN (SELECT url FROM visited)"))
def q_resume_run(spark, sf):
    pages = t(spark, sf, "pages")
    todo, _ = D.resume(X.visited(pages), pages.select("page_id", "url"))
    return todo.select(U.normalize_url("url").alias("url"))


@register("resume_visited", _VIS + f"SELECT url FROM visited UNION SELECT {O.normalize('url')} FROM pages")
def q_resume_visited(spark, sf):
    """The visited table that a resumed run leaves."""
    pages = t(spark, sf, "pages")
    return D.resume(X.visited(pages), pages.select("page_id", "url"))[1]


# ============================================================ K: crawl
def _reach_sql(max_depth: int | None) -> str:
    bound = f"r.depth < {max_depth}" if max_depth else "r.depth < (SELECT count(*) FROM pages)"
    return (_TREE.rstrip("\n") + (
        ", reach(host, url, depth) AS (SELECT host, url, 0 FROM tree_seeds UNION "
        f"SELECT e.host, e.dst, r.depth + 1 FROM reach r JOIN site_tree e ON e.host = r.host AND e.src = r.url WHERE {bound})\n"
        "SELECT host, url, CAST(min(depth) AS BIGINT) AS depth FROM reach GROUP BY host, url"
    )).replace("WITH ", "WITH RECURSIVE ", 1)


@register("crawl_depth_limited", _reach_sql(2))
def q_crawl_depth_limited(spark, sf):
    pages = t(spark, sf, "pages")
    r = K.crawl_reach(X.tree_seeds(pages), X.site_tree(pages), pages, max_depth=2)
    return r.filter(F.col("depth") <= 2).select("host", "url", F.col("depth").cast("long").alias("depth"))


def _budget_sql(max_pages: int) -> str:
    """Sequential oracle for K3: one recursion step pops one URL per site (FIFO), exactly the
    crawler's loop; state is (queue, seen, depths, hashes, statuses) as lists."""
    route = f"({O.category('k_url')} IS NULL OR {O.suffix('k_url')} IN ('.html', '.htm'))"
    keys = (f"SELECT host, url, h FROM (SELECT {O.netloc('url')} AS host, {O.normalize('url')} AS url, md5(html) AS h, "
            f"row_number() OVER (PARTITION BY {O.netloc('url')}, {O.normalize('url')} ORDER BY page_id) AS rn FROM crawl_pages) WHERE rn = 1")
    links = "SELECT host, src, list(dst ORDER BY pos, dst) AS dsts FROM crawl_tree GROUP BY host, src"
    step = (
        "SELECT host, step + 1 AS step, list_concat(queue[2:], fresh) AS queue, list_concat(seen, fresh) AS seen, "
        "list_concat(depths, list_transform(fresh, lambda x: d + 1)) AS depths, "
        "CASE WHEN st = 'processed' THEN list_append(hashes, h) ELSE hashes END AS hashes, list_append(statuses, st) AS statuses FROM ("
        "SELECT *, CASE WHEN st = 'processed' THEN list_filter(coalesce(dsts, []::VARCHAR[]), "
        "lambda x, i: NOT list_contains(seen, x) AND list_position(dsts, x) = i) ELSE []::VARCHAR[] END AS fresh FROM ("
        f"SELECT s.*, k.h, l.dsts, s.depths[s.step + 1] AS d, CASE WHEN k.h IS NULL THEN 'failed' WHEN NOT {route} THEN 'file' "
        "WHEN list_contains(s.hashes, k.h) THEN 'duplicate' ELSE 'processed' END AS st FROM "
        "(SELECT *, queue[1] AS k_url FROM budget) s LEFT JOIN keys k ON k.host = s.host AND k.url = s.k_url "
        f"LEFT JOIN links l ON l.host = s.host AND l.src = s.k_url WHERE len(s.queue) > 0 AND len(s.seen) < {max_pages}))"
    )
    body = O.cte(site_tree=O.SITE_TREE, tree_seeds=O.TREE_SEEDS, crawl_pages=O.CRAWL_PAGES, crawl_tree=O.CRAWL_TREE, keys=keys, links=links).rstrip("\n") + (
        ", budget(host, step, queue, seen, depths, hashes, statuses) AS ("
        "SELECT host, 0, [url], [url], [0], []::VARCHAR[], []::VARCHAR[] FROM tree_seeds UNION ALL " + step + ")\n"
        "SELECT host, url, CAST(depth AS BIGINT) AS depth, CAST(rank AS BIGINT) AS rank, "
        "CASE WHEN rank > step THEN 'skipped' ELSE statuses[rank] END AS status FROM ("
        "SELECT host, step, statuses, unnest(seen) AS url, unnest(depths) AS depth, generate_subscripts(seen, 1) AS rank FROM "
        "(SELECT * FROM budget QUALIFY row_number() OVER (PARTITION BY host ORDER BY step DESC) = 1))"
    )
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


def _crawl(spark, sf, **limits):
    pages = t(spark, sf, "pages")
    r = K.crawl_reach(X.tree_seeds(pages), X.crawl_tree(pages), X.crawl_pages(pages), **limits)
    return r.select("host", "url", F.col("depth").cast("long").alias("depth"), F.col("rank").cast("long").alias("rank"), "status")


@register("crawl_reach", _budget_sql(1 << 60))
def q_crawl_reach(spark, sf):
    """K1, K4: every discovered URL with depth, discovery rank and status, against a sequential crawl."""
    return _crawl(spark, sf)


@register("crawl_budget", _budget_sql(5))
def q_crawl_budget(spark, sf):
    return _crawl(spark, sf, max_pages=5)


_BATCH_SQL = _FETCH + (
    "SELECT page_id, host, CAST(seq AS BIGINT) AS seq, CAST((seq - 1) // 5 AS BIGINT) AS batch, CAST((seq - 1) // 5 AS DOUBLE) * 0.2::DOUBLE AS offset_s FROM ("
    "SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS seq FROM fetches)"
)


@register("fetch_schedule", _BATCH_SQL)
def q_fetch_schedule(spark, sf):
    f = X.fetches(t(spark, sf, "pages")).select("page_id", "host")
    s = K.fetch_schedule(f, 5, 0.2, ["host"], ["page_id"])
    return s.select("page_id", "host", F.col("seq").cast("long").alias("seq"), "batch", "offset_s")


_GRAPH = (f"SELECT page_id, host, src, dst, pos FROM ({_EDGES_BODY}) UNION ALL SELECT page_id, host, src, dst, 1000 + pos FROM site_tree")


@register("graph_summary", O.cte(nav_links=O.NAV_LINKS, site_tree=O.SITE_TREE, g=_GRAPH, e="SELECT host, src, dst FROM g GROUP BY ALL",
                                 f="SELECT host, src FROM (SELECT host, src, row_number() OVER (PARTITION BY host, dst ORDER BY page_id, pos, src) AS n FROM g) WHERE n = 1") + (
    "SELECT host, url, CAST(coalesce(o.out_degree, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.in_degree, 0) AS BIGINT) AS in_degree, "
    "CAST(coalesce(o.dangling, 0) AS BIGINT) AS dangling, CAST(coalesce(w.n, 0) AS BIGINT) AS new_links FROM "
    "(SELECT host, src AS url, count(*) AS out_degree, count(*) FILTER (WHERE dst NOT IN (SELECT " + O.normalize("url") + " FROM pages)) AS dangling "
    "FROM e GROUP BY 1, 2) o FULL JOIN (SELECT host, dst AS url, count(*) AS in_degree FROM e GROUP BY 1, 2) i USING (host, url) "
    "LEFT JOIN (SELECT host, src AS url, count(*) AS n FROM f GROUP BY 1, 2) w USING (host, url)"))
def q_graph_summary(spark, sf):
    """K7 over the pages' own links (targets unknown) and the site trees (targets known)."""
    pages = t(spark, sf, "pages")
    e = L.link_edges(pages).withColumn("pos", F.col("pos").cast("int")).unionByName(X.site_tree(pages).withColumn("pos", F.col("pos") + 1000))
    keys = pages.select(U.normalize_url("url").alias("url"))
    return L.graph_summary(e, keys).select("host", "url", *_long("out_degree", "in_degree", "dangling", "new_links"))


# ============================================================ T: attempts and stats
_ATT = O.cte(attempts=O.ATTEMPTS)


@register("retry_outcome", _ATT + (
    "SELECT url, coalesce(upto <= 3, false) AS ok, CAST(CASE WHEN coalesce(upto <= 3, false) THEN upto ELSE least(n, 3) END AS BIGINT) AS attempts_used FROM ("
    "SELECT url, count(*) AS n, min(CASE WHEN ok THEN k END) AS upto FROM ("
    "SELECT url, ok, row_number() OVER (PARTITION BY url ORDER BY ts, seq) AS k FROM attempts) GROUP BY url)"))
def q_retry_outcome(spark, sf):
    return T.retry_outcome(X.attempts(t(spark, sf, "events")), 3)


@register("backoff", _ATT + (
    "SELECT url, seq, k AS attempt, 0.5::DOUBLE * w AS wait_s, 0.5::DOUBLE * sum(w) OVER (PARTITION BY url ORDER BY ts, seq) AS total_wait_s FROM ("
    "SELECT *, CASE WHEN ok THEN 0 ELSE k END AS w FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, seq) AS k FROM attempts))"))
def q_backoff(spark, sf):
    b = T.backoff(X.attempts(t(spark, sf, "events")), 0.5)
    return b.select("url", "seq", F.col("attempt").cast("long").alias("attempt"), "wait_s", "total_wait_s")


@register("failed_urls", _ATT + (
    "SELECT url, CAST(1 AS BIGINT) AS errors FROM (SELECT url, min(CASE WHEN ok THEN k END) AS upto FROM ("
    "SELECT url, ok, row_number() OVER (PARTITION BY url ORDER BY ts, seq) AS k FROM attempts) GROUP BY url) WHERE coalesce(upto <= 3, false) = false"))
def q_failed_urls(spark, sf):
    return T.failed_urls(T.retry_outcome(X.attempts(t(spark, sf, "events")), 3))


@register("error_counts", O.cte(attempts=O.ATTEMPTS, fetches=O.FETCHES, responses=O.RESPONSES, outcomes=O.outcome("strict")) + (
    "SELECT 'retries' AS source, count(*) AS errors FROM (SELECT url, min(CASE WHEN ok THEN k END) AS upto FROM ("
    "SELECT url, ok, row_number() OVER (PARTITION BY url ORDER BY ts, seq) AS k FROM attempts) GROUP BY url) WHERE coalesce(upto <= 3, false) = false "
    "UNION ALL SELECT 'download', count(*) FILTER (WHERE outcome IN ('error', 'not_found')) FROM outcomes "
    "UNION ALL SELECT 'parse', count(*) FILTER (WHERE outcome = 'parse_error') FROM outcomes"))
def q_error_counts(spark, sf):
    """Errors by source."""
    return T.error_counts(T.retry_outcome(X.attempts(t(spark, sf, "events")), 3), _outcomes(spark, sf))


@register("failed_fetches", _RESP + f"SELECT host, url, outcome FROM ({O.outcome('strict')}) WHERE outcome IN ('error', 'not_found', 'parse_error')")
def q_failed_fetches(spark, sf):
    """T4: the failed list."""
    return T.failed_fetches(_outcomes(spark, sf))


_STATS_SQL = O.cte(fetches=O.FETCHES, responses=O.RESPONSES, nav_links=O.NAV_LINKS, outcomes=O.outcome("strict"), edges=_EDGES_BODY) + (
    "SELECT o.host, CAST(count(*) FILTER (WHERE outcome IN ('html_ok', 'html_empty', 'pdf_ok', 'pdf_empty')) AS BIGINT) AS pages_processed, "
    "CAST(count(*) FILTER (WHERE outcome = 'downloaded') AS BIGINT) AS files_downloaded, CAST(count(*) FILTER (WHERE outcome = 'duplicate') AS BIGINT) AS duplicates, "
    "CAST(count(*) FILTER (WHERE outcome IN ('error', 'not_found', 'parse_error')) AS BIGINT) AS errors, "
    "CAST(epoch(max(fetch_ts)) - epoch(min(fetch_ts)) AS BIGINT) AS duration_s, CAST(count(DISTINCT url) AS BIGINT) AS pages_fetched, "
    "CAST(any_value(d.n) AS BIGINT) AS pages_crawled FROM outcomes o JOIN (SELECT host, count(DISTINCT url) AS n FROM ("
    "SELECT host, url FROM outcomes UNION ALL SELECT host, dst FROM edges) GROUP BY host) d ON d.host = o.host GROUP BY o.host"
)
_STATS = ("pages_processed", "files_downloaded", "duplicates", "errors", "duration_s", "pages_fetched", "pages_crawled")


@register("crawl_stats", _STATS_SQL)
def q_crawl_stats(spark, sf):
    """T4; discovered are the fetched URLs and the in-site links (H12) of all pages."""
    found = L.link_edges(t(spark, sf, "pages")).select("host", F.col("dst").alias("url"))
    return T.crawl_stats(_outcomes(spark, sf), found).select("host", *_long(*_STATS))


@register("files_by_category", _FILES + (
    "SELECT k.host, c.category, CAST(coalesce(n.files, 0) AS BIGINT) AS files FROM (SELECT DISTINCT host FROM files) k CROSS JOIN (VALUES "
    + ", ".join(f"('{c}')" for c in [*O.CATALOGUES['wide'], 'other']) + ") c(category) LEFT JOIN ("
    f"SELECT host, {O.category('url')} AS category, count(DISTINCT url) AS files FROM files GROUP BY 1, 2) n ON n.host = k.host AND n.category = c.category"))
def q_files_by_category(spark, sf):
    f = X.files(t(spark, sf, "pages")).withColumn("category", U.file_category("url"))
    return T.files_by_category(f)


@register("endpoint_stats", _ATT + (
    "SELECT endpoint, count(*) AS total_used, count(*) FILTER (WHERE ok) AS successful_requests, count(*) FILTER (WHERE NOT ok) AS failed_requests, "
    "avg(CASE WHEN ok THEN latency END) AS speed FROM attempts GROUP BY endpoint"))
def q_endpoint_stats(spark, sf):
    s = T.endpoint_stats(X.attempts(t(spark, sf, "events")))
    return s.select("endpoint", *_long("total_used", "successful_requests", "failed_requests"), "speed")


@register("rank_endpoints", _ATT + (
    "SELECT endpoint, speed, CAST(row_number() OVER (ORDER BY speed ASC NULLS LAST, endpoint) AS INTEGER) AS speed_rank FROM ("
    "SELECT endpoint, avg(CASE WHEN ok THEN latency END) AS speed, count(*) FILTER (WHERE ok) AS s FROM attempts GROUP BY endpoint) WHERE s > 0"))
def q_rank_endpoints(spark, sf):
    r = T.rank_endpoints(T.endpoint_stats(X.attempts(t(spark, sf, "events"))))
    return r.select("endpoint", "speed", F.col("speed_rank").cast("int").alias("speed_rank"))


@register("round_robin", (
    f"SELECT page_id, host, CAST((row_number() OVER (PARTITION BY host ORDER BY page_id) - 1) % 3 AS BIGINT) AS endpoint FROM "
    f"(SELECT page_id, {O.netloc('url')} AS host FROM pages)"))
def q_round_robin(spark, sf):
    p = t(spark, sf, "pages").select("page_id", U.url_netloc("url").alias("host"))
    return T.assign_round_robin(p, 3, ["host"], ["page_id"]).select("page_id", "host", "endpoint")


@register("durations", _ATT + "SELECT url, epoch(max(ts)) - epoch(min(ts)) AS duration_s, count(*) AS tries FROM attempts GROUP BY url")
def q_durations(spark, sf):
    return T.durations(X.attempts(t(spark, sf, "events")))


# ============================================================ ST: streaming (availableNow runs, read back)
from pageflow.streaming import jobs as ST  # noqa: E402

_ST1_SQL = (
    f"SELECT page_id, {O.page_text('html')} AS text, CAST(len(list_distinct(list_filter(list_transform({O.hrefs('html')}, "
    f"lambda h: {O.normalize('h', 'url')}), lambda x: {O.is_valid('x', O.netloc('url'))}))) AS BIGINT) AS n_links FROM pages"
)


@register("stream_ingest", _ST1_SQL)
def q_stream_ingest(spark, sf):
    return spark.read.parquet(ST.ingest_pages(spark, f"{sf}/pages.parquet"))


@register("stream_dedup", O.cte(crawl_pages=O.CRAWL_PAGES) + "SELECT DISTINCT md5(html) AS h FROM crawl_pages")
def q_stream_dedup(spark, sf):
    """ST2 over pages with repeated bodies that arrive in several micro-batches."""
    pages = _sink_dir(spark, "arrivals")
    X.crawl_pages(t(spark, sf, "pages")).repartitionByRange(4, "page_id").write.parquet(pages)
    return spark.read.parquet(ST.dedup_stream(spark, pages, max_files=1)).select("h")


@register("stream_visited", O.cte(visited=O.VISITED) + f"SELECT url FROM visited UNION SELECT {O.normalize('url')} FROM pages")
def q_stream_visited(spark, sf):
    pages = t(spark, sf, "pages")
    return ST.read_visited(spark, ST.visited_upsert_stream(spark, f"{sf}/pages.parquet", X.visited(pages)))


@register("stream_links", O.cte(nav_links=O.NAV_LINKS, edges=_EDGES_BODY) + (
    "SELECT page_id, host, src, dst, pos, NOT EXISTS (SELECT 1 FROM edges s WHERE s.page_id % 3 = 0 AND s.host = e.host AND s.dst = e.dst) AS is_new FROM edges e"))
def q_stream_links(spark, sf):
    """ST1's links (H12) and new URLs (D2) over several micro-batches; a third of the pages were seen by an earlier run."""
    pages, out = t(spark, sf, "pages"), _sink_dir(spark, "links")
    files = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # of each of the four micro-batches
    pages.repartitionByRange(4 * files, "page_id").write.parquet(f"{out}/arrivals")
    sink = ST.LinkSink(spark, out, buckets=16)
    sink.start(L.link_edges(pages.filter("page_id % 3 = 0")).select("host", F.col("dst").alias("url")))
    ST.link_stream(spark, f"{out}/arrivals", sink, f"{out}/checkpoint", max_files=files)
    new = sink.read("frontier").select("host", F.col("url").alias("dst"), F.lit(True).alias("new"))
    edges = sink.read("edges").join(new, ["host", "dst"], "left")
    return edges.select("page_id", "host", "src", "dst", F.col("pos").cast("long").alias("pos"), F.coalesce("new", F.lit(False)).alias("is_new"))


@register("stream_upsert", QUERIES["upsert_crawled"][1])
def q_stream_upsert(spark, sf):
    """ST3 with D6: the crawled table of an earlier run, then a run's results that arrive in several micro-batches."""
    crawled, batch = X.crawled_and_batch(t(spark, sf, "pages"))
    out = _sink_dir(spark, "upserts")
    table = ST.crawled_table(spark, f"{out}/table", buckets=16)
    table.merge(crawled, -1)
    batch.repartitionByRange(4, "url").write.parquet(f"{out}/arrivals")
    ST.upsert_stream(spark, f"{out}/arrivals", table, f"{out}/checkpoint", max_files=1)
    return table.read().select("url", F.col("status").cast("int").alias("status"), F.col("batch_no").cast("long").alias("batch_no"))


@register("stream_counters", (
    "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, "
    "count(*) FILTER (WHERE event_type = 'error') AS errors, sum(value) AS value_sum FROM events GROUP BY 1, 2"))
def q_stream_counters(spark, sf):
    return spark.read.parquet(ST.event_counters(spark, f"{sf}/events.parquet"))


# ============================================================ S2, S6-S8: sinks written, then scanned back
def _sink_dir(spark: SparkSession, name: str) -> str:
    return ST.scratch(spark, name)


@register("file_scan", "SELECT CAST(sum(strlen(url) + strlen(html) + 2) AS BIGINT) AS bytes, count(*) AS records FROM pages")
def q_file_scan(spark, sf):
    """S2 over files Spark writes from the pages table, URLs and bodies: read back as binary files
    (metadata only) and, for the record count, as text split at the records' end sign."""
    out = _sink_dir(spark, "files")
    p = t(spark, sf, "pages")
    p.select(F.concat("url", F.lit("\n"), "html").alias("value")).write.mode("overwrite").option("lineSep", "\x00").text(out)
    size = S.read_files(spark, out, glob="*.txt").select("length", F.lit(0).alias("n"))
    lines = spark.read.option("lineSep", "\x00").text(out).select(F.lit(0).cast("long").alias("length"), F.lit(1).alias("n"))
    return size.unionAll(lines).agg(F.sum("length").cast("long").alias("bytes"), F.sum("n").cast("long").alias("records"))


@register("metadata_sink", O.cte(fetches=O.FETCHES) + (
    "SELECT host, count(*) AS records, CAST(sum(status_code) AS BIGINT) AS status_sum FROM fetches GROUP BY host"))
def q_metadata_sink(spark, sf):
    """Page metadata written as one JSON document per record, clustered by site, read back."""
    out = _sink_dir(spark, "meta")
    f = X.fetches(t(spark, sf, "pages")).select("host", "url", "status_code", "content_type", U.url_key("url", ".json").alias("key"))
    S.write_metadata(f, out)
    back = spark.read.schema("host STRING, url STRING, status_code INT, content_type STRING, key STRING").json(out)
    return back.groupBy("host").agg(F.count("*").alias("records"), F.sum("status_code").cast("long").alias("status_sum"))


@register("stats_sink", _STATS_SQL)
def q_stats_sink(spark, sf):
    """Per-site crawl statistics written as one JSON document per site, read back."""
    out = _sink_dir(spark, "stats")
    S.write_stats(q_crawl_stats(spark, sf), out)
    back = spark.read.schema("host STRING, " + ", ".join(f"{c} LONG" for c in _STATS)).json(out)
    return back.select("host", *_STATS)


@register("text_sink", (
    f"SELECT {O.netloc('url')} AS host, count(*) AS records, CAST(sum(length({O.page_text('html')})) AS BIGINT) AS text_chars, "
    "count(DISTINCT md5(url) || '.txt') AS keys FROM pages GROUP BY 1"))
def q_text_sink(spark, sf):
    """Page text records keyed by URL hash, written clustered by site, read back."""
    out = _sink_dir(spark, "text")
    p = t(spark, sf, "pages")
    recs = p.select(U.url_netloc("url").alias("host"), U.url_key("url", ".txt").alias("key"), H.page_text("html").alias("text"))
    S.write_text(recs, out)
    back = spark.read.parquet(out)
    return back.groupBy("host").agg(F.count("*").alias("records"), F.sum(F.length("text")).cast("long").alias("text_chars"),
                                    F.count_distinct("key").alias("keys"))
