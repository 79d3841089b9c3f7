"""DuckDB SQL for the oracle check: expression builders and the derived-view CTEs.

The driver runs each ``oracle_sql()`` string in DuckDB over the same parquet tables.
These builders produce plain SQL text (RE2 regexes, list lambdas); arguments are SQL
expressions, usually column names of a CTE, so statements stay readable.
"""

from __future__ import annotations

import functools
import html.entities
import itertools
import urllib.parse

from pageflow.plans.fixtures import FILE_EXTS, METHODS

# The standard library's lists, and patterns and catalogues stated apart from the engine's.
USES_PARAMS, USES_RELATIVE = urllib.parse.uses_params, urllib.parse.uses_relative
URL_JUNK = r"^[\x00-\x20]+|[\t\r\n]"
URL_SPLIT = r"^(?:([a-zA-Z][-+.a-zA-Z0-9]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
# The extension catalogues, a line per category.
_CATALOGUE_LINES = """
document .pdf .doc .docx .txt .rtf .odt
spreadsheet .xls .xlsx .csv .ods
presentation .ppt .pptx .odp
archive .zip .rar .7z .tar .gz
image .jpg .jpeg .png .gif .bmp .svg
audio .mp3 .wav .ogg .m4a
video .mp4 .avi .mkv .mov
code .py .js .html .css .java .cpp .h
data .json .xml .yaml .sql
ebook .epub .mobi .azw
"""
_WIDE = {c: exts for c, *exts in (x.split() for x in _CATALOGUE_LINES.split("\n") if x)}
CATALOGUES = {"wide": _WIDE, "narrow": {k: v for k, v in _WIDE.items() if k not in ("code", "data", "ebook")}}

# Python's whitespace class in RE2 (RE2's \s lacks \v).
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- URLs
def cleaned(u: str) -> str:
    """What urlsplit parses: leading C0 controls/spaces and tab/CR/LF removed."""
    return f"regexp_replace({u}, {lit(URL_JUNK)}, '', 'g')"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({cleaned(u)}, {lit(URL_SPLIT)}, 1))"


def netloc(u: str) -> str:
    return f"regexp_extract({cleaned(u)}, {lit(URL_SPLIT)}, 2)"


def raw_path(u: str) -> str:
    return f"regexp_extract({cleaned(u)}, {lit(URL_SPLIT)}, 3)"


def _in(x: str, values: list[str]) -> str:
    return f"({x} IN ({', '.join(lit(v) for v in values)}))"


def no_params(p: str, sch: str) -> str:
    return f"(CASE WHEN {_in(sch, USES_PARAMS)} THEN regexp_replace({p}, ';[^/]*$', '') ELSE {p} END)"


def path(u: str) -> str:
    return no_params(raw_path(u), scheme(u))


def query(u: str) -> str:
    return f"regexp_extract({cleaned(u)}, {lit(URL_SPLIT)}, 4)"


def fragment(u: str) -> str:
    return f"regexp_extract({cleaned(u)}, {lit(URL_SPLIT)}, 5)"


def site_base(u: str) -> str:
    return f"({scheme(u)} || '://' || {netloc(u)})"


def rstrip_slash(s: str) -> str:
    return f"regexp_replace({s}, '/+$', '')"


_counter = itertools.count()


def let(value: str, fn) -> str:
    """Bind ``value`` once as a lambda variable (SQL text would otherwise repeat it)."""
    v = f"v{next(_counter)}"
    return f"(list_transform([{value}], lambda {v}: {fn(v)})[1])"


def _walk(merged: str, relative: str) -> str:
    def with_segs(segs0: str) -> str:
        segs_expr = f"(CASE WHEN {relative} THEN list_filter({segs0}, lambda x, i: i = 1 OR i = len({segs0}) OR x <> '') ELSE {segs0} END)"

        def with_pruned(segs: str) -> str:
            walked = (f"list_reduce({segs}, lambda acc, x: CASE WHEN x = '..' THEN acc[1:-2] WHEN x = '.' THEN acc "
                      f"ELSE list_append(acc, x) END, []::VARCHAR[])")

            def finish(w: str) -> str:
                joined = f"array_to_string({w}, '/')"
                joined = f"(CASE WHEN {segs}[-1] IN ('.', '..') AND len({w}) > 0 THEN {joined} || '/' ELSE {joined} END)"
                return let(f"(CASE WHEN {joined} = '' THEN '/' ELSE {joined} END)",
                           lambda j: f"(CASE WHEN starts_with({j}, '/') THEN {j} ELSE '/' || {j} END)")

            return let(walked, finish)

        return let(segs_expr, with_pruned)

    return let(f"string_split({merged}, '/')", with_segs)


def resolve(base: str, ref: str) -> str:
    """``scheme://netloc/path`` of ``urljoin(base, ref)`` (params/query/fragment dropped)."""
    parts = (f"{{'bs': {scheme(base)}, 'bn': {netloc(base)}, 'bp': {raw_path(base)}, 'rs': {scheme(ref)}, "
             f"'rn': {netloc(ref)}, 'rp': {raw_path(ref)}, 'empty': ({ref} IS NULL OR {ref} = '')}}")

    def body(p: str) -> str:
        bs, bn, rs, rn, rp_raw = f"{p}.bs", f"{p}.bn", f"{p}.rs", f"{p}.rn", f"{p}.rp"
        eff = f"(CASE WHEN {rs} = '' THEN {bs} ELSE {rs} END)"
        passthrough = f"(({rs} <> '' AND {rs} <> {bs}) OR NOT {_in(eff, USES_RELATIVE)})"
        derived = (f"{{'eff': {eff}, 'pt': {passthrough}, 'bp': {no_params(f'{p}.bp', bs)}, "
                   f"'rp': {no_params(rp_raw, f'(CASE WHEN {passthrough} THEN {rs} ELSE {eff} END)')}}}")

        def finish(d: str) -> str:
            pt, bp, rp = f"{d}.pt", f"{d}.bp", f"{d}.rp"
            netted = f"(NOT {pt} AND {rn} <> '')"
            relative = f"(NOT starts_with({rp}, '/'))"
            merged = f"(CASE WHEN {relative} THEN regexp_extract(CASE WHEN {bp} = '' THEN '/' ELSE {bp} END, '^(.*/)', 1) || {rp} ELSE {rp} END)"
            path_ = f"(CASE WHEN {pt} OR {netted} THEN {rp} WHEN {rp_raw} = '' THEN {bp} ELSE {_walk(merged, relative)} END)"
            sch = f"(CASE WHEN {pt} THEN {rs} ELSE {d}.eff END)"
            net = f"(CASE WHEN {pt} OR {netted} THEN {rn} ELSE {bn} END)"
            return f"(CASE WHEN {p}.empty THEN {bs} || '://' || {bn} || {bp} ELSE {sch} || '://' || {net} || {path_} END)"

        return let(derived, finish)

    return let(parts, body)


def normalize(u: str, base: str | None = None, mode: str = "whole") -> str:
    if mode == "path":
        return f"({scheme(u)} || '://' || {netloc(u)} || regexp_replace({path(u)}, '/+$', ''))"
    if base is None:
        return rstrip_slash(f"({scheme(u)} || '://' || {netloc(u)} || {path(u)})")
    return rstrip_slash(resolve(base, u))


def is_valid(u: str, host: str, assets: bool = True) -> str:
    low = f"lower({u})"
    bad = f"regexp_matches({low}, '(login|logout|signin|signout|auth)') OR regexp_matches({low}, '#.*$')"
    if assets:
        bad += f" OR regexp_matches({low}, '\\.(css|js|json|xml)$')"
    n = netloc(u)
    return f"({u} IS NOT NULL AND {u} <> '' AND ({n} = '' OR {n} = {host}) AND NOT ({bad}))"


SUFFIX = r"[^/](\.[^/.]+)(?:/+\.?)*$"


def suffix(u: str, mode: str = "path") -> str:
    src = path(u) if mode == "path" else u
    return f"lower(regexp_extract({src}, {lit(SUFFIX)}, 1))"


def category(u: str, catalogue: str = "wide", mode: str = "path") -> str:
    ext = suffix(u, mode)
    whens = " ".join(f"WHEN {ext} IN ({', '.join(lit(e) for e in exts)}) THEN {lit(c)}" for c, exts in CATALOGUES[catalogue].items() if exts)
    return f"(CASE WHEN {ext} = '' THEN NULL {whens} ELSE 'other' END)"


def md5(u: str) -> str:
    return f"md5({u})"


# ---------------------------------------------------------------- HTML
# Stated apart from the engine's patterns (RE2 has no possessive quantifiers or look-around).
ATTRS = r"""(?:[^<>=]|=\s*(?:"[^"]*"|'[^']*')?)*"""
ANY_TAG = rf"<[!/?A-Za-z]{ATTRS}>"
# What numeric references to 128-159 stand for.
C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
BLOCK_LEVEL = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "div", "nav", "article", "section", "footer", "header",
               "main", "aside", "form", "blockquote", "body", "html", "table", "td", "th"]


def strip_elements(h: str, tags: tuple[str, ...] = ("script", "style")) -> str:
    alts = [r"<!--.*?(?:-->|\z)"]
    for t in tags:
        alts.append(rf"<{t}(?:[\s/]{ATTRS})?>" if t in ("meta", "link") else rf"<{t}[\s/>].*?(?:</{t}[\s/]*>|\z)")
    return f"regexp_replace({h}, {lit('(?is)' + '|'.join(alts))}, '', 'g')"


@functools.cache
def _names() -> tuple[str, str]:
    """All names with ';' and those without, as DuckDB maps."""

    def as_map(pairs: dict[str, str]) -> str:
        return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in pairs.items()) + "}"

    return as_map(html.entities.html5), as_map({k: v for k, v in html.entities.html5.items() if ";" not in k})


def unescape(c: str) -> str:
    """``html.unescape``: pieces behind each '&', numbers and names in one pass."""
    names, old = _names()
    dec, hx = r"regexp_extract(y, '^#([0-9]+)', 1)", r"regexp_extract(y, '^#[xX]([0-9a-fA-F]+)', 1)"
    number = (f"CASE WHEN {dec} <> '' THEN CASE WHEN length(ltrim({dec}, '0')) > 7 THEN 1114112 ELSE CAST({dec} AS BIGINT) END "
              f"ELSE CASE WHEN length(ltrim({hx}, '0')) > 7 THEN 1114112 ELSE CAST('0x' || {hx} AS BIGINT) END END")
    char = (f"CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n BETWEEN 128 AND 159 THEN {lit(C1)}[n - 127] "
            "WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n & 65534 = 65534 THEN '' "
            "ELSE chr(CAST(n AS INTEGER)) END")
    digits = "regexp_replace(y, '^#([0-9]+|[xX][0-9a-fA-F]+);?', '')"
    word = r"regexp_extract(y, '^[^\t\n\f <&#;]{1,32};?')"
    prefixes = " ".join(f"WHEN length(w) > {k} AND {old}[w[1:{k}]] IS NOT NULL THEN {old}[w[1:{k}]] || substr(y, {k + 1})" for k in (6, 5, 4, 3, 2))
    named = f"CASE WHEN w = '' THEN '&' || y WHEN {names}[w] IS NOT NULL THEN {names}[w] || substr(y, length(w) + 1) {prefixes} ELSE '&' || y END"
    piece = (f"CASE WHEN j = 1 THEN y WHEN regexp_matches(y, '^#([0-9]|[xX][0-9a-fA-F])') THEN list_transform([{number}], lambda n: {char})[1] || {digits} "
             f"ELSE list_transform([{word}], lambda w: {named})[1] END")
    return f"(CASE WHEN contains({c}, '&') THEN array_to_string(list_transform(string_split({c}, '&'), lambda y, j: {piece}), '') ELSE {c} END)"


def strip_ws(c: str) -> str:
    return f"regexp_replace({c}, {lit('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def clean(c: str) -> str:
    return strip_ws(f"regexp_replace({c}, {lit(WS + '+')}, ' ', 'g')")


def text_nodes(body: str) -> str:
    pieces = f"regexp_split_to_array({body}, {lit(ANY_TAG)})"
    return f"list_filter(list_transform({pieces}, lambda x: {strip_ws(unescape('x'))}), lambda x: x <> '')"


def page_text(h: str, sep: str = " ", tags: tuple[str, ...] = ("script", "style")) -> str:
    return f"array_to_string({text_nodes(strip_elements(h, tags))}, {lit(sep)})"


TITLE_TAG = rf"(?is)<title(?:[\s/]{ATTRS})?>(.*?)</title"


def title(h: str) -> str:
    return let(f"regexp_extract({strip_elements(h)}, {lit(TITLE_TAG)}, 1)", lambda r: f"CASE WHEN {r} <> '' THEN {unescape(r)} END")


def block_text(h: str) -> str:
    """Without a stack: for each block's opening tag the tag that ends it, from list levels. A paragraph ends at
    any block-level tag, a heading at any heading tag, an item at an item tag of its list or its list's end."""
    names = "|".join(BLOCK_LEVEL)
    pattern = lit(rf"(?i)</?(?:{names})(?:[\s/]{ATTRS})?>")

    def with_tags(b: str) -> str:
        tag = "{'t': lower(regexp_extract(x, '^</?([A-Za-z0-9]+)', 1)), 'o': NOT starts_with(x, '</')}"
        piece = clean(unescape(f"regexp_replace(x, {lit(ANY_TAG)}, ' ', 'g')"))
        parts = (f"{{'t': list_transform(regexp_extract_all({b}, {pattern}), lambda x: {tag}), "
                 f"'q': list_transform(regexp_split_to_array({b}, {pattern}), lambda x: {piece})}}")

        def with_levels(p: str) -> str:
            step = f"list_transform({p}.t, lambda x: CASE WHEN x.t IN ('ul', 'ol') THEN CASE WHEN x.o THEN 1 ELSE -1 END ELSE 0 END)"
            levels = let(step, lambda v: f"list_transform(range(1, len({v}) + 1), lambda k: list_sum({v}[1:k]))")

            def blocks(lev: str) -> str:
                t = f"{p}.t"
                ends = (f"(CASE {t}[i].t WHEN 'p' THEN true WHEN 'li' THEN ({t}[j].t = 'li' AND {lev}[j] = {lev}[i]) OR {lev}[j] < {lev}[i] "
                        f"ELSE starts_with({t}[j].t, 'h') AND length({t}[j].t) = 2 END)")
                end = f"coalesce(list_filter(range(i + 1, len({t}) + 1), lambda j: {ends})[1], len({t}) + 1)"
                starts = f"list_filter(range(1, len({t}) + 1), lambda i: {t}[i].o AND {t}[i].t IN ('p', 'li', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6'))"
                texts = f"list_transform({starts}, lambda i: array_to_string(list_filter({p}.q[i + 1:{end}], lambda x: x <> ''), ' '))"
                return f"array_to_string(list_filter({texts}, lambda x: x <> ''), ' ')"

            return let(levels, blocks)

        return let(parts, with_levels)

    return let(strip_elements(h), with_tags)


def visible_text(h: str) -> str:
    body = strip_elements(h, ("script", "style", "noscript"))
    head = rf"(?is)<title(?:[\s/]{ATTRS})?>.*?</title\s*>|<!doctype[^>]*>|<head(?:[\s/]{ATTRS})?>[^<]*"
    body = f"regexp_replace({body}, {lit(head)}, ' ', 'g')"
    return clean(unescape(f"regexp_replace({body}, {lit(ANY_TAG)}, ' ', 'g')"))


ANCHOR = rf"(?i)<a[\s/]{ATTRS}>"
ATTRIBUTE = r"""\s([^\s<>=/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>][^\s<>]*)"""


def hrefs(h: str) -> str:
    """First ``href`` among the attributes of every whole anchor tag."""
    tags = f"regexp_extract_all({strip_elements(h)}, {lit(ANCHOR)})"
    attr = lit(ATTRIBUTE)
    value = f"regexp_extract_all(g, {attr}, 2)[list_position(list_transform(regexp_extract_all(g, {attr}, 1), lambda k: lower(k)), 'href')]"
    raw = f"list_filter(list_transform({tags}, lambda g: {value}), lambda v: v IS NOT NULL)"
    unquoted = "CASE WHEN v[1] = chr(34) OR v[1] = chr(39) THEN v[2:-2] ELSE v END"
    return f"list_transform({raw}, lambda v: {unescape(unquoted)})"


# ---------------------------------------------------------------- derived views (CTE bodies)
def cte(**views: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in views.items()) + "\n"


SITES = f"SELECT {netloc('url')} AS host, arg_min({site_base('url')}, page_id) AS base_url FROM pages GROUP BY 1"

NAV_LINKS = (
    f"SELECT page_id, host, CAST(pos - 1 AS INTEGER) AS pos, href FROM (SELECT page_id, {netloc('url')} AS host, "
    f"unnest({hrefs('html')}) AS href, generate_subscripts({hrefs('html')}, 1) AS pos FROM pages)"
)

PAGE_REFS = (
    "SELECT host, href AS url FROM nav_links UNION ALL "
    f"SELECT {netloc('a.url')} AS host, b.url FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 UNION ALL "
    f"SELECT {netloc('url')} AS host, {normalize('url')} || CASE page_id % 7 WHEN 0 THEN '/login' WHEN 1 THEN '/author' "
    "WHEN 2 THEN '.css' WHEN 3 THEN '#x' WHEN 4 THEN '/' WHEN 5 THEN '?q=1' ELSE '' END AS url FROM pages"
)

FETCHES = (
    f"SELECT page_id, {netloc('url')} AS host, url, html, CAST(CASE WHEN page_id % 20 = 7 THEN 404 WHEN page_id % 20 = 13 THEN 500 "
    "ELSE 200 END AS INTEGER) AS status_code, CASE page_id % 10 WHEN 3 THEN 'application/pdf' WHEN 5 THEN 'image/png' "
    "WHEN 8 THEN 'Text/HTML; charset=utf-8' ELSE 'text/html' END AS content_type, "
    "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS fetch_ts FROM pages"
)

HEADERS = ("'{\"Content-Type\":\"' || content_type || '\",\"Content-Length\":\"' || CAST(strlen(html) AS VARCHAR) || '\"' || "
           "CASE WHEN page_id % 3 <> 0 THEN ',\"ETag\":\"' || md5(html) || '\"' ELSE '' END || '}'")

FILES = (
    f"SELECT s.host, p.page_id, s.base_url || '/f/doc' || CAST(p.page_id % 5 AS VARCHAR) || "
    f"[{', '.join(lit(e) for e in FILE_EXTS)}][CAST(p.page_id % 8 + 1 AS INTEGER)] AS url "
    f"FROM (SELECT page_id, {netloc('url')} AS host FROM pages) p JOIN sites s ON s.host = p.host"
)

ROBOTS = (
    "SELECT host, 'User-agent: *' || nl || 'Disallow: /x' || nl || CASE WHEN length(host) % 2 = 0 THEN 'sitemap:' ELSE 'Sitemap:' END "
    "|| ' ' || base_url || '/sitemap.xml ' || nl AS text FROM (SELECT *, CASE WHEN length(host) % 3 = 0 THEN chr(13) || chr(10) "
    "ELSE chr(10) END AS nl FROM sites)"
)

_RESP_HTML = ("CASE WHEN page_id % 50 = 9 THEN NULL WHEN page_id % 31 = 4 THEN '<html><body><div> </div></body></html>' "
              "WHEN page_id % 6 = 1 THEN '<p>shared ' || CAST(page_id % 4 AS VARCHAR) || '</p>' ELSE html END")
RESPONSES = (
    f"SELECT page_id, host, CASE WHEN page_id % 3 = 2 THEN {site_base('url')} || '/f/doc' || CAST(page_id AS VARCHAR) || "
    f"['.zip', '.pdf', '.csv'][CAST(page_id % 3 + 1 AS INTEGER)] ELSE url END AS url, {_RESP_HTML} AS html, status_code, content_type, fetch_ts FROM fetches"
)


def outcome(mode: str) -> str:
    """Outcome rows of the ``responses`` view, from the rules and not from the engine's order of joins."""
    low = "lower(coalesce(content_type, ''))"
    is_file = f"({category('url')} IS NOT NULL AND {suffix('url')} NOT IN ('.html', '.htm'))"
    if mode == "strict":
        pdf = f"(contains({low}, 'application/pdf') OR ends_with(lower(url), '.pdf'))"
        kind = f"CASE WHEN status_code = 404 THEN 'not_found' WHEN status_code >= 400 THEN 'error' WHEN {pdf} THEN 'pdf' WHEN contains({low}, 'text/html') THEN 'html' ELSE 'unsupported' END"
    else:
        kind = "CASE WHEN status_code >= 400 THEN 'error' WHEN contains(coalesce(content_type, ''), 'text/html') THEN 'html' ELSE 'skipped_non_html' END"
    base = f"SELECT page_id, host, url, fetch_ts, html, {is_file} AS is_file, {kind} AS kind FROM responses"
    ranked = (f"SELECT *, kind = 'html' AND NOT is_file AND html IS NOT NULL AS accepted FROM ({base})")
    first = (f"SELECT *, row_number() OVER (PARTITION BY accepted, md5(html) ORDER BY page_id) AS nth FROM ({ranked})")
    return (f"SELECT page_id, host, url, fetch_ts, CASE WHEN kind IN ('not_found', 'error') THEN kind WHEN is_file THEN 'downloaded' "
            "WHEN kind IN ('unsupported', 'skipped_non_html') THEN kind WHEN html IS NULL THEN 'parse_error' WHEN accepted AND nth > 1 THEN 'duplicate' "
            f"WHEN {block_text('html')} = '' THEN kind || '_empty' ELSE kind || '_ok' END AS outcome FROM ({first})")


SITE_TREE = (
    f"SELECT a.page_id, a.host, a.key AS src, b.key AS dst, CAST(t.pos AS INTEGER) AS pos FROM "
    f"(SELECT page_id, {netloc('url')} AS host, {normalize('url')} AS key, row_number() OVER (PARTITION BY {netloc('url')} ORDER BY page_id) AS r FROM pages) a "
    "CROSS JOIN (VALUES (0), (1), (2)) t(pos) "
    "JOIN (SELECT host, key, r FROM (SELECT " + netloc("url") + " AS host, " + normalize("url") + " AS key, "
    "row_number() OVER (PARTITION BY " + netloc("url") + " ORDER BY page_id) AS r FROM pages)) b "
    "ON b.host = a.host AND b.r = CASE t.pos WHEN 0 THEN 2 * a.r WHEN 1 THEN 2 * a.r + 1 ELSE CASE WHEN a.r > 1 THEN 1 END END"
)

_ZIP = f"{site_base('url')} || '/f/doc' || CAST(page_id % 3 AS VARCHAR) || '.zip'"
CRAWL_PAGES = (
    "SELECT page_id, url, CASE WHEN page_id % 6 = 4 THEN 'same ' || CAST(page_id % 2 AS VARCHAR) ELSE html END AS html FROM pages "
    f"UNION ALL SELECT page_id + 1000000000000, {_ZIP}, 'zip' || CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 8 = 3"
)
CRAWL_TREE = (
    "SELECT * FROM site_tree UNION ALL "
    f"SELECT page_id, {netloc('url')}, {normalize('url')}, {normalize('url')} || '/missing', 3 FROM pages WHERE page_id % 4 = 1 UNION ALL "
    f"SELECT page_id, {netloc('url')}, {normalize('url')}, {normalize('zip')}, 4 FROM (SELECT *, {_ZIP} AS zip FROM pages) WHERE page_id % 8 = 3"
)

TREE_SEEDS = f"SELECT {netloc('url')} AS host, arg_min({normalize('url')}, page_id) AS url FROM pages GROUP BY 1"

CANDIDATES = (
    "SELECT doc_id, [" + ", ".join(lit(m) for m in METHODS) + "][r] AS method, CAST(r AS INTEGER) AS method_rank, "
    "CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) || ' ' WHEN doc_id % 9 = r THEN '' "
    "ELSE CASE r WHEN 1 THEN text WHEN 2 THEN replace(text, chr(10), ' ') "
    "ELSE CASE WHEN doc_id % 4 = 0 THEN text || ' ' || lang ELSE replace(text, ' ', '') END END END AS text "
    "FROM documents CROSS JOIN (VALUES (1), (2), (3)) m(r)"
)

REGION_TABLES = (
    "SELECT r.r_regionkey, 0 AS table_no, coalesce(t.cells, []::VARCHAR[][]) AS cells FROM region r LEFT JOIN "
    "(SELECT n_regionkey, list([CAST(n_nationkey AS VARCHAR), n_name, NULL::VARCHAR] ORDER BY n_nationkey) AS cells "
    "FROM nation GROUP BY n_regionkey) t ON t.n_regionkey = r.r_regionkey "
    "UNION ALL SELECT r_regionkey, 1 AS table_no, []::VARCHAR[][] AS cells FROM region"
)

DOC_TABLES = (
    "SELECT c.doc_id, c.doc_id % 3 AS page_no, t.table_no, t.cells FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) c "
    "JOIN region_tables t ON c.doc_id % 5 = t.r_regionkey"
)

PARTS = "SELECT conv_id AS doc_id, turn AS page_no, text FROM conversations"

ATTEMPTS = (
    "SELECT 'u' || CAST(user_id AS VARCHAR) AS url, event_id % 7 AS endpoint, ts, event_id AS seq, "
    "event_type <> 'error' AS ok, value AS latency FROM events"
)

VISITED = f"SELECT DISTINCT {normalize('url')} AS url FROM pages WHERE page_id % 2 = 0"
