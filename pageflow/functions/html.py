"""HTML to text and links as native Column expressions.

No tree parser: documents are cut at tags with regular expressions and the pieces are
handled with higher-order array functions, all inside the JVM. The rules (documented
in the README) are the ones a forgiving HTML parser applies.
"""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageflow.functions.blocks import block_ends
from pageflow.functions.urls import ColumnOrName, _col, let

# Python's str.isspace() set, as a Java regex class (Java's \s is ASCII only).
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
# The same set as characters (what str.isspace() accepts).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
            "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Element sets removed before text extraction.
DROP_SCRIPT_STYLE = ("script", "style")
DROP_WITH_NOSCRIPT = ("script", "style", "noscript")
DROP_WITH_META = ("script", "style", "meta", "link")
# The tags that end a block.
BOUNDARY_TAGS = ("p", "h[1-6]", "li", "ul", "ol", "div", "nav", "article", "section", "footer", "header", "main", "aside",
                 "form", "blockquote", "body", "html", "table", "td", "th")
# What the code points 0x80-0x9F of numeric references stand for, in order.
C1_REFERENCES = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
# Code points (six hexadecimal digits) that a numeric reference can't give, and those that give nothing.
NO_CHARACTER = "^(?:000000|00D[89A-F]..|110000)$"
NO_TEXT = "^0000(?:0[1-8BEF]|1.|7F)$|^00FD[DE].$|FFF[EF]$"

# Attributes step over quoted values (quotes count after '=' only), so a '>' inside one doesn't end
# the tag; a '<' outside quotes does, so a stray '<' in text costs O(1) instead of a scan to
# the end of the document.
ATTRIBUTES = r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
# A tag is '<' + letter, '/', '!' or '?' and attributes up to the next '>'.
TAG = rf"<[!/?A-Za-z]{ATTRIBUTES}>"


# Void elements (no closing tag): only the tag itself is removed.
VOID_TAGS = ("meta", "link")


def _element_pattern(tags: tuple[str, ...]) -> str:
    # an element or comment that is never closed runs to the end of the document
    alts = "|".join(rf"<{t}(?:[\s/]{ATTRIBUTES})?>" if t in VOID_TAGS else rf"<{t}[\s/>].*?(?:</{t}[\s/]*>|\z)" for t in tags)
    return rf"(?is)<!--.*?(?:-->|\z)|{alts}"


def strip_elements(html: ColumnOrName, tags: tuple[str, ...] = DROP_SCRIPT_STYLE) -> Column:
    """H1: drop comments and whole non-content elements (tag, attributes and content)."""
    return F.regexp_replace(_col(html), _element_pattern(tags), "")


@cache
def _decoder() -> str:
    """The decoder of one text as a SQL lambda: written once, so that a use costs the driver two calls.

    The text is cut at '&'. Each piece behind one starts with a reference (``w``) or doesn't; a reference by number
    gives its digits without leading zeros (``d``), then six hexadecimal digits (``h``).
    """
    by: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        by.setdefault(name[0], {})[name] = text
    old = {k: v for k, v in html5.items() if not k.endswith(";")}
    held = lambda x: "r'" + json.dumps(x).replace("'", "\\u0027") + "'"
    names, legacy = f"from_json({held(by)}, 'map<string, map<string, string>>')", f"from_json({held(old)}, 'map<string, string>')"
    prefix = "^(?:" + "|".join(sorted(old, key=len, reverse=True)) + ")"
    bind = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    text = f"""CASE WHEN h RLIKE r'{NO_CHARACTER}' THEN '\ufffd' WHEN h RLIKE r'{NO_TEXT}' THEN ''
        WHEN h RLIKE '^0000[89]' THEN substring('{C1_REFERENCES}', CAST(conv(right(h, 2), 16, 10) AS INT) - 127, 1)
        ELSE decode(unhex(concat('00', h)), 'UTF-32') END"""
    # more than seven digits are beyond all code points in either base
    code = "CASE WHEN length(d) > 7 THEN 1114112 WHEN d = '' THEN 0 ELSE least(1114112, CAST(IF(w RLIKE '^#[xX]', conv(d, 16, 10), conv(d, 10, 10)) AS INT)) END"
    number = bind("regexp_replace(w, '^#[xX]?0*|;$', '')", "d", bind(f"lpad(hex({code}), 6, '0')", "h", text))
    by_prefix = bind(f"regexp_extract(w, '{prefix}', 0)", "p", f"concat(try_element_at({legacy}, p), substring(x, length(p) + 1))")
    read = f"""coalesce(concat(IF(startswith(w, '#'), {number}, try_element_at(try_element_at({names}, left(w, 1)), w)), substring(x, length(w) + 1)),
        {by_prefix}, concat('&', x))"""
    word = r"regexp_extract(x, r'^(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|[^\t\n\f <&#;]{1,32});?', 0)"
    return f"v -> IF(contains(v, '&'), array_join(transform(split(v, '&'), (x, i) -> IF(i = 0, x, {bind(word, 'w', read)})), ''), v)"


def unescape_html(c: ColumnOrName) -> Column:
    """Decode character references in one pass, as HTML5 (and ``html.unescape``) reads them:
    numeric ones of any length, all named ones, the old names without ';' by longest prefix."""
    return F.element_at(F.call_function("transform", F.array(_col(c)), F.expr(_decoder())), 1)


def strip_ws(c: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace (``btrim`` with the
    exact character set; no regex scan over the text)."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def clean_text(c: ColumnOrName) -> Column:
    """H8: every whitespace run becomes one space; trimmed (only single spaces remain at
    the ends, so a plain space trim is exact)."""
    return F.trim(F.regexp_replace(_col(c), rf"{WS}+", " "))


def _text_nodes(body: Column) -> Column:
    """Text nodes between tags: decoded, stripped, empties dropped (``stripped_strings``)."""
    return F.filter(F.transform(F.split(body, TAG), lambda x: strip_ws(unescape_html(x))), lambda x: x != "")


def page_title(html: ColumnOrName) -> Column:
    """H2: decoded text of the first ``<title>`` outside comments, scripts and styles; NULL when absent or empty."""

    def first(body: Column) -> Column:
        raw = F.regexp_extract(body, rf"(?is)<title(?:[\s/]{ATTRIBUTES})?>(.*?)</title", 1)
        return F.when(raw != "", unescape_html(raw))

    return let(strip_elements(html), first)


def page_text(html: ColumnOrName, sep: str = " ", drop: tuple[str, ...] = DROP_SCRIPT_STYLE) -> Column:
    """H3 (sep ' ') / H6 (sep '\\n'): stripped text nodes joined; title included, inner whitespace kept."""
    return F.array_join(_text_nodes(strip_elements(html, drop)), sep)


def line_text(html: ColumnOrName) -> Column:
    """H6: text nodes newline-joined, with script/style/meta/link removed."""
    return page_text(html, "\n", DROP_WITH_META)


def alt_text(html: ColumnOrName) -> Column:
    """H7: whole-document text, space-joined and cleaned to one line."""
    return clean_text(page_text(html, " "))


def block_text(html: ColumnOrName) -> Column:
    """H4: whole texts of p/h1-h6/li blocks in document order, cleaned to one line. A block inside another
    one is part of the outer text and comes again by itself."""
    name = "|".join(BOUNDARY_TAGS)
    pattern = rf"(?i)<(/?)({name})(?:[\s/]{ATTRIBUTES})?>"

    def texts(parts: Column) -> Column:
        pieces = F.transform(parts["pieces"], lambda x: clean_text(unescape_html(F.regexp_replace(x, TAG, " "))))

        def joined(at: Column) -> Column:
            blocks = F.transform(at["ends"], lambda b: F.array_join(F.filter(F.slice(at["pieces"], b["i"] + 1, b["e"] - b["i"]), lambda x: x != ""), " "))
            return F.array_join(F.filter(blocks, lambda x: x != ""), " ")

        return let(F.struct(pieces.alias("pieces"), block_ends(parts["tags"]).alias("ends")), joined)

    def cut(body: Column) -> Column:
        return let(F.struct(F.split(body, pattern).alias("pieces"), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("tags")), texts)

    return let(strip_elements(html, DROP_SCRIPT_STYLE), cut)


def without_block_text(html: ColumnOrName) -> Column:
    """True where :func:`block_text` is empty. A block that starts with a visible character settles it; only
    pages without one are read block by block."""
    starts = rf"(?i)<(?:p|h[1-6]|li)(?:[\s/]{ATTRIBUTES})?>{WS}*+[^&<\s\x1c-\x1f\x85\p{{Z}}]"
    return let(strip_elements(html), lambda body: F.when(body.rlike(starts), False).otherwise(F.coalesce(F.length(block_text(html)), F.lit(0)) == 0))


def visible_text(html: ColumnOrName) -> Column:
    """H5: text nodes outside head/title/script/style/noscript/meta and comments, cleaned."""
    body = strip_elements(html, DROP_WITH_NOSCRIPT)
    body = F.regexp_replace(body, rf"(?is)<title(?:[\s/]{ATTRIBUTES})?>.*?</title\s*>|<!doctype[^>]*>|<head(?:[\s/]{ATTRIBUTES})?>[^<]*", " ")
    return clean_text(unescape_html(F.regexp_replace(body, TAG, " ")))


def text_or_alternative(html: ColumnOrName) -> Column:
    """H9: block text, else the alternative whole-document text, else ''."""
    return F.coalesce(F.nullif(block_text(html), F.lit("")), F.nullif(alt_text(html), F.lit("")), F.lit(""))


def with_source(text: ColumnOrName, url: ColumnOrName, style: str = "markdown", compat: bool = False) -> Column:
    """Prefix a source header: ``[Source](url)`` (markdown) or ``URL: url`` (plain).

    ``compat=True`` reproduces cleaning after the header: the blank line collapses to a space.
    """
    text, url = _col(text), _col(url)
    if style == "markdown":
        head = F.concat(F.lit("[Source]("), url, F.lit(")"))
    elif style == "plain":
        head = F.concat(F.lit("URL: "), url)
    else:
        raise ValueError(f"unknown header style {style!r}")
    if compat:
        return clean_text(F.concat(head, F.lit("\n\n"), text))
    return F.concat(head, F.lit("\n\n"), text)


# An anchor's first href attribute: double-quoted, single-quoted or bare; other attributes are stepped over.
_OTHER = r"""(?:\s+(?!href[\s=/>])[^\s<>=/]++(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s"'<>][^\s<>]*+))?+|\s*/)*+"""
HREF = rf"""(?i)<a(?=[\s/]){_OTHER}\s+href\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'<>][^\s<>]*+)"""


def extract_hrefs(html: ColumnOrName) -> Column:
    """Every ``<a href>`` value in document order outside comments, scripts and styles, quotes removed
    and entity-decoded."""
    raw = F.regexp_extract_all(strip_elements(html), F.lit(HREF), 1)
    return F.transform(raw, lambda v: unescape_html(F.regexp_replace(v, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")))
