"""URL algebra as native Column expressions.

Everything here is JVM-side (regex, split/aggregate higher-order functions), so it
stays inside whole-stage codegen stages and never crosses into Python.
Semantics follow the standard library's ``urlparse`` / ``urljoin`` / ``pathlib``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# RFC 3986 appendix B split (scheme, netloc, path); query/fragment follow.
URL_SPLIT = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"

# The two extension catalogues (category -> extensions), in catalogue order.
CATALOGUE_WIDE = {
    "document": [".pdf", ".doc", ".docx", ".txt", ".rtf", ".odt"],
    "spreadsheet": [".xls", ".xlsx", ".csv", ".ods"],
    "presentation": [".ppt", ".pptx", ".odp"],
    "archive": [".zip", ".rar", ".7z", ".tar", ".gz"],
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg"],
    "audio": [".mp3", ".wav", ".ogg", ".m4a"],
    "video": [".mp4", ".avi", ".mkv", ".mov"],
    "code": [".py", ".js", ".html", ".css", ".java", ".cpp", ".h"],
    "data": [".json", ".xml", ".yaml", ".sql"],
    "ebook": [".epub", ".mobi", ".azw"],
    "other": [],
}
CATALOGUE_NARROW = {
    "document": [".pdf", ".doc", ".docx", ".txt", ".rtf", ".odt"],
    "spreadsheet": [".xls", ".xlsx", ".csv", ".ods"],
    "presentation": [".ppt", ".pptx", ".odp"],
    "archive": [".zip", ".rar", ".7z", ".tar", ".gz"],
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg"],
    "audio": [".mp3", ".wav", ".ogg", ".m4a"],
    "video": [".mp4", ".avi", ".mkv", ".mov"],
    "other": [],
}
CATALOGUES = {"wide": CATALOGUE_WIDE, "narrow": CATALOGUE_NARROW}

# Suffix of the last path segment, as pathlib's Path.suffix
# (dot-files, no dot and a trailing dot give no suffix; trailing "/" and "/." ignored).
SUFFIX_PATTERN = r"[^/](\.[^/.]+)(?:/+\.?)*$"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Schemes whose last path segment carries ";params", and schemes that
# resolve relative references (the standard library's uses_params / uses_relative).
USES_PARAMS = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip",
               "sips", "mms", "sftp", "tel"]
USES_RELATIVE = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero",
                 "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]

# What urlsplit removes before parsing - leading C0 controls and spaces, and
# tab / CR / LF anywhere.
URL_JUNK = r"^[\x00-\x20]+|[\t\r\n]"


C0_OR_SPACE = "".join(chr(i) for i in range(0x21))


def _clean(u: Column) -> Column:
    """``URL_JUNK`` removed with character functions (no regex scan): tab/CR/LF deleted,
    then leading C0 controls and spaces trimmed."""
    return F.ltrim(F.translate(u, "\t\r\n", ""), F.lit(C0_OR_SPACE))


def url_parts(u: ColumnOrName) -> Column:
    """``urlparse`` parts as a struct(scheme, netloc, path, params, query, fragment).

    scheme is lower-cased; netloc verbatim; path excludes ``;params`` of the last segment.
    """
    return let(_clean(_col(u)), _parts_of)


def _no_params(path: Column, scheme: Column) -> Column:
    """Drop ``;params`` of the last segment when the scheme has params."""
    return F.when(scheme.isin(*USES_PARAMS), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)


def _parts_of(u: Column) -> Column:
    raw_path = F.regexp_extract(u, URL_SPLIT, 3)
    scheme = F.lower(F.regexp_extract(u, URL_SPLIT, 1))
    has_params = scheme.isin(*USES_PARAMS)
    return F.struct(
        scheme.alias("scheme"),
        F.regexp_extract(u, URL_SPLIT, 2).alias("netloc"),
        _no_params(raw_path, scheme).alias("path"),
        F.when(has_params, F.regexp_extract(raw_path, r";([^/]*)$", 1)).otherwise(F.lit("")).alias("params"),
        F.regexp_extract(u, URL_SPLIT, 4).alias("query"),
        F.regexp_extract(u, URL_SPLIT, 5).alias("fragment"),
    )


def url_scheme(u: ColumnOrName) -> Column:
    return F.lower(F.regexp_extract(_clean(_col(u)), URL_SPLIT, 1))


def url_netloc(u: ColumnOrName) -> Column:
    """netloc exactly as ``urlparse(u).netloc`` (case, port and userinfo kept)."""
    return F.regexp_extract(_clean(_col(u)), URL_SPLIT, 2)


def url_path(u: ColumnOrName) -> Column:
    """``urlparse(u).path``: no query, fragment or last-segment params."""
    return let(_clean(_col(u)), lambda c: _no_params(F.regexp_extract(c, URL_SPLIT, 3), F.lower(F.regexp_extract(c, URL_SPLIT, 1))))


def site_base(u: ColumnOrName) -> Column:
    """``scheme://netloc`` of a URL."""
    return F.concat(url_scheme(u), F.lit("://"), url_netloc(u))


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable.

    Nested Column helpers would otherwise copy the same sub-expression into every place
    that uses it (the plan grows geometrically with nesting); binding keeps it linear.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def _remove_dot_segments(path: Column, relative: Column) -> Column:
    """urljoin's segment walk: drop empty middle segments (relative refs only), skip ".",
    pop on "..", and end with "/" when the last segment was "." or ".."."""

    def walk(segs: Column) -> Column:
        walked = F.aggregate(
            segs,
            F.array().cast("array<string>"),
            lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(x == ".", acc)
            .otherwise(F.array_append(acc, x)),
        )

        def finish(w: Column) -> Column:
            joined = F.array_join(w, "/")
            ends_dot = F.element_at(segs, -1).isin(".", "..")
            joined = F.when(ends_dot & (F.size(w) > 0), F.concat(joined, F.lit("/"))).otherwise(joined)
            return let(F.when(joined == "", F.lit("/")).otherwise(joined),
                       lambda j: F.when(j.startswith("/"), j).otherwise(F.concat(F.lit("/"), j)))

        return let(walked, finish)

    def prune(segs: Column) -> Column:
        return F.when(relative, F.filter(segs, lambda x, i: (i == 0) | (i == F.size(segs) - 1) | (x != ""))).otherwise(segs)

    return let(let(F.split(path, "/"), prune), walk)


def base_parts(base: ColumnOrName) -> Column:
    """Parts of a base URL, computed once per row and reused for every reference resolved
    against it (pass to ``resolve_parts(..., parts=...)``)."""
    return let(_clean(_col(base)), lambda b: F.struct(
        F.lower(F.regexp_extract(b, URL_SPLIT, 1)).alias("bs"), F.regexp_extract(b, URL_SPLIT, 2).alias("bn"),
        F.regexp_extract(b, URL_SPLIT, 3).alias("bp")))


def resolve_parts(base: ColumnOrName | None, ref: ColumnOrName, parts: Column | None = None) -> Column:
    """``urlparse(urljoin(base, ref))`` as struct(scheme, netloc, path) - path without params.

    ``parts`` (from :func:`base_parts`) replaces ``base`` when the base is shared by many refs.
    """
    raw_ref = _col(ref)
    bparts = parts if parts is not None else base_parts(base)

    def gather(r: Column) -> Column:
        return F.struct(
            bparts["bs"].alias("bs"), bparts["bn"].alias("bn"), bparts["bp"].alias("bp"),
            F.lower(F.regexp_extract(r, URL_SPLIT, 1)).alias("rs"), F.regexp_extract(r, URL_SPLIT, 2).alias("rn"),
            F.regexp_extract(r, URL_SPLIT, 3).alias("rp"), (raw_ref.isNull() | (raw_ref == "")).alias("empty"),
        )

    parts = let(_clean(raw_ref), gather)

    def body(p: Column) -> Column:
        bs, bn, rs, rn, rp_raw = p["bs"], p["bn"], p["rs"], p["rn"], p["rp"]
        eff = F.when(rs == "", bs).otherwise(rs)
        # a foreign or non-relative scheme returns the reference unchanged
        passthrough = ((rs != "") & (rs != bs)) | ~eff.isin(*USES_RELATIVE)
        netted = ~passthrough & (rn != "")
        bp = _no_params(p["bp"], bs)
        rp = _no_params(rp_raw, F.when(passthrough, rs).otherwise(eff))
        relative = ~rp.startswith("/")
        merged = F.when(relative, F.concat(F.regexp_extract(F.when(bp == "", F.lit("/")).otherwise(bp), r"^(.*/)", 1), rp)).otherwise(rp)

        def walk_if_needed(m: Column) -> Column:
            # Dot-segment walk only where it can change something; otherwise the path is final.
            needs_walk = relative | m.rlike(r"/\.\.?(/|$)")
            return F.when(needs_walk, _remove_dot_segments(m, relative)).otherwise(m)

        path = F.when(passthrough | netted, rp).when(rp_raw == "", bp).otherwise(let(merged, walk_if_needed))
        return F.struct(
            F.when(p["empty"], bs).when(passthrough, rs).otherwise(eff).alias("scheme"),
            F.when(p["empty"], bn).when(passthrough | netted, rn).otherwise(bn).alias("netloc"),
            F.when(p["empty"], bp).otherwise(path).alias("path"),
        )

    return let(parts, body)


def resolve_url(base: ColumnOrName | None, ref: ColumnOrName, parts: Column | None = None) -> Column:
    """U2 as a string ``scheme://netloc/path`` (query/fragment dropped)."""
    return let(resolve_parts(base, ref, parts), lambda p: F.concat(p["scheme"], F.lit("://"), p["netloc"], p["path"]))


def normalize_url(u: ColumnOrName, base: ColumnOrName | None = None, mode: str = "whole", parts: Column | None = None) -> Column:
    """Canonical URL key.

    mode ``whole``: resolve against ``base`` (when given), keep ``scheme://netloc/path``,
    drop params/query/fragment, strip every trailing ``/`` of the whole string.
    mode ``path``: no resolve, strip ``/`` from the path only.
    """
    u = _col(u)
    if mode == "path":
        return F.concat(url_scheme(u), F.lit("://"), url_netloc(u), F.regexp_replace(url_path(u), r"/+$", ""))
    if mode != "whole":
        raise ValueError(f"unknown normalize mode {mode!r}")
    if base is None and parts is None:
        s = let(_clean(u), lambda c: F.concat(
            F.lower(F.regexp_extract(c, URL_SPLIT, 1)), F.lit("://"), F.regexp_extract(c, URL_SPLIT, 2),
            _no_params(F.regexp_extract(c, URL_SPLIT, 3), F.lower(F.regexp_extract(c, URL_SPLIT, 1)))))
    else:
        s = resolve_url(base, u, parts)
    return F.regexp_replace(s, r"/+$", "")


def same_site(u: ColumnOrName, host: ColumnOrName, strict: bool = False) -> Column:
    """Netloc equals the site's host; lenient mode also passes an empty netloc."""
    h = _col(host)
    if strict:
        return url_netloc(u) == h
    return let(url_netloc(u), lambda n: (n == "") | (n == h))


# Exclusion patterns applied to the lower-cased URL.
EXCLUDE_AUTH = r"(login|logout|signin|signout|auth)"
EXCLUDE_FRAGMENT = r"#.*$"
EXCLUDE_ASSET = r"\.(css|js|json|xml)$"


def is_valid_url(u: ColumnOrName, host: ColumnOrName, assets: bool = True) -> Column:
    """Non-empty, same site (lenient) and no exclusion pattern on the lower-cased URL.

    ``assets=False`` is the two-pattern variant (no ``.css/.js/.json/.xml`` rule).
    """
    h = _col(host)

    def check(v: Column) -> Column:
        low = F.lower(v)
        pattern = "|".join([EXCLUDE_AUTH, EXCLUDE_FRAGMENT] + ([EXCLUDE_ASSET] if assets else []))
        n = url_netloc(v)
        return F.coalesce(v != "", F.lit(False)) & ((n == "") | (n == h)) & ~low.rlike(pattern)

    return let(_col(u), check)


def exclude_substrings(u: ColumnOrName, needles: list[str]) -> Column:
    """None of the (site-specific) substrings occurs in the URL."""
    u = _col(u)
    cond = F.lit(True)
    for n in needles:
        cond = cond & ~u.contains(n)
    return cond


def url_suffix(u: ColumnOrName, mode: str = "path") -> Column:
    """Lower-cased ``Path(...).suffix``: of the URL path (``path``) or the raw URL (``raw``); '' when none."""
    u = _col(u)
    src = url_path(u) if mode == "path" else u
    return F.lower(F.regexp_extract(src, SUFFIX_PATTERN, 1))


def category_map(catalogue: str = "wide") -> Column:
    """Literal MAP<ext, category> for a catalogue (first category wins)."""
    cat = CATALOGUES[catalogue]
    pairs: list[Column] = []
    seen: set[str] = set()
    for category, exts in cat.items():
        for e in exts:
            if e not in seen:
                seen.add(e)
                pairs += [F.lit(e), F.lit(category)]
    return F.create_map(*pairs)


def file_category(u: ColumnOrName, catalogue: str = "wide", mode: str = "path") -> Column:
    """Category of the URL's extension; unknown extension -> 'other'; no extension -> NULL."""
    ext = url_suffix(u, mode)
    known = F.try_element_at(category_map(catalogue), F.when(ext == "", F.lit("-")).otherwise(ext))
    return F.when(ext == "", F.lit(None).cast("string")).otherwise(F.coalesce(known, F.lit("other")))


def route_url(u: ColumnOrName, catalogue: str = "wide", mode: str = "path") -> Column:
    """U10: 'file' when the URL has a (downloadable) category, else 'page'."""
    return F.when(file_category(u, catalogue, mode).isNotNull(), F.lit("file")).otherwise(F.lit("page"))


def url_key(u: ColumnOrName, suffix: str = "") -> Column:
    """Hex MD5 of the UTF-8 URL plus a storage suffix ('.txt', '.json', '_pdf.txt', '_file.json')."""
    k = F.md5(F.encode(_col(u), "UTF-8"))
    return F.concat(k, F.lit(suffix)) if suffix else k


def sanitize_filename(u: ColumnOrName, mode: str = "short") -> Column:
    """U12 (``short``) / U13 (``long``) file names derived from a URL."""
    u = _col(u)
    digest = F.md5(F.encode(u, "UTF-8"))
    if mode == "short":
        kept = F.regexp_replace(F.substring(u, 1, 50), r"[^-_.() A-Za-z0-9]", "")
        return F.regexp_replace(F.concat(kept, F.lit("_"), digest), r"\.+$", "")
    if mode == "long":
        name = F.regexp_replace(u, r"[^\p{L}\p{N}_\-.]", "_")
        return F.when(F.length(name) > 200, F.concat(F.substring(name, 1, 150), F.lit("_"), F.substring(digest, 1, 10))).otherwise(name)
    raise ValueError(f"unknown sanitize mode {mode!r}")


def unquote(u: ColumnOrName) -> Column:
    """Percent-decoding; '+' stays '+', a malformed escape leaves the string as is."""
    u = _col(u)
    return F.when(u.contains("%"), F.coalesce(F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))), u)).otherwise(u)


def path_basename(u: ColumnOrName) -> Column:
    """``os.path.basename(urlparse(u).path)``."""
    return F.regexp_extract(url_path(u), r"([^/]*)$", 1)
