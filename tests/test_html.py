"""HTML text/link functions: stdlib ``html.parser`` differential on the pages table, plus golden cases."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pageflow.functions import html as H


class _Walk(HTMLParser):
    """Reference walk: text nodes outside script/style/comments, first title, anchor hrefs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = []
        self.texts = []
        self.hrefs = []
        self.title = None
        self._in_title = False
        self._title_parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.stack.append(tag)
        if tag == "title" and self.title is None:
            self._in_title = True
        if tag == "a":
            for k, v in attrs:
                if k == "href":
                    self.hrefs.append(v or "")
                    break

    def handle_endtag(self, tag):
        if self.stack and self.stack[-1] == tag:
            self.stack.pop()
        if tag == "title" and self._in_title:
            self._in_title = False
            self.title = "".join(self._title_parts) or None

    def handle_data(self, data):
        if self.stack:
            return
        if self._in_title:
            self._title_parts.append(data)
        self.texts.append(data)


def _walk(html):
    w = _Walk()
    w.feed(html)
    w.close()
    return w


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def test_text_title_links_match_html_parser(pages):
    rows = pages.select("page_id", "html", H.page_text("html").alias("t"), H.page_title("html").alias("ti"),
                        H.extract_hrefs("html").alias("h")).collect()
    assert len(rows) > 0
    for r in rows:
        w = _walk(r.html)
        assert r.t == " ".join(s.strip() for s in w.texts if s.strip()), r.page_id
        assert r.ti == w.title, r.page_id
        assert list(r.h) == w.hrefs, r.page_id


GOLDEN = [
    ("<p>a<p>b</p><li>c</li>", "a b c"),
    ("<ul><li>x <b>y</b></li></ul><div>z</div>", "x y"),
    ("<h1>T&amp;T</h1><p>&copy; 2024&nbsp;x</p>", "T&T © 2024 x"),
    ("<script>var a='<p>no</p>';</script><p>yes</p>", "yes"),
    ("<div>none</div>", ""),
    ("<li><div>inside</div></li><li>ok</li>", "inside ok"),
    ("<li>one<ul><li>two</li></ul>tail</li>", "one two tail two"),
    ("<li><section><h2>t</h2>body</section></li>", "t body t"),
    ("<ul><li>x<li>y<ul><li>z</ul>w</ul><p>q<div>r</div>", "x y z w z q"),
    ("<table><tr><td><p>in</td><td>out</table><h1>a<h2>b</h2>", "in a b"),
    ("</li></p><p>open", "open"),
]


@pytest.mark.parametrize("html,expected", GOLDEN)
def test_block_text_golden(spark, html, expected):
    got = spark.createDataFrame([(html,)], "html string").select(H.block_text("html").alias("b")).first().b
    assert got == expected


def test_visible_and_fallback_golden(spark):
    html = "<!DOCTYPE html><html><head><title>Ti</title><style>x{}</style></head><body><!-- c --><div>A  &lt;b&gt;</div>" \
           "<noscript>ns</noscript><span>B</span></body></html>"
    df = spark.createDataFrame([(html, "https://e.com/x")], "html string, url string")
    r = df.select(H.visible_text("html").alias("v"), H.text_or_alternative("html").alias("f"),
                  H.with_source(H.text_or_alternative("html"), "url").alias("s"),
                  H.with_source(H.text_or_alternative("html"), "url", compat=True).alias("c"),
                  H.line_text("html").alias("l")).first()
    assert r.v == "A <b> B"
    assert r.f == "Ti A <b> ns B"
    assert r.s == "[Source](https://e.com/x)\n\nTi A <b> ns B"
    assert r.c == "[Source](https://e.com/x) Ti A <b> ns B"
    assert r.l == "Ti\nA  <b>\nns\nB"


def test_unescape_matches_the_standard_library(spark):
    """All names, alone and run into other text, numbers of every kind, and random texts."""
    import html
    import random
    from html.entities import html5

    rng = random.Random(1)
    parts = [*"&#;xX019aAltgmpqunbs ", "&amp", "&lt;", "&#", "&not", "&copy"]
    rows = [f"a&{k} b" for k in html5] + [f"x&{k.rstrip(';')}y;z" for k in html5]
    rows += [f"&#{n};" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x10FFFF, 0x110000, 10**30]] + [f"&#x{n:x}" for n in range(0, 300, 7)]
    rows += ["&#38;lt;", "&#x26;amp;", "&#00000000000233;", "&#x", "&#;", "&;", "&&amp;&", "&eacute;t&eacute;", "&notit; &notin;"]
    rows += ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select("s", H.unescape_html("s").alias("u")).collect()
    assert [r.u for r in got] == [html.unescape(r.s) for r in got]


LINKS = [
    ("""<!-- <a href="/old"> --><script>'<a href="/js">'</script><a href="/real">""", ["/real"]),
    ('<a title="a > b" href="/x">', ["/x"]),
    ("<a data-href='/no' href=/y>t</a><abbr href='/q'>", ["/y"]),
    ('<A HREF = "/z" href="/w"><a\nclass=x\nhref=\'/s\'>', ["/z", "/s"]),
    ('<a href="/p?a=1&amp;b=2">', ["/p?a=1&b=2"]),
    ("<a name=it's href=/b>", ["/b"]),
]


@pytest.mark.parametrize("html,expected", LINKS)
def test_links_golden(spark, html, expected):
    got = spark.createDataFrame([(html,)], "html string").select(H.extract_hrefs("html").alias("h")).first().h
    assert got == expected == _walk(html).hrefs


TEXTS = [
    ('<img alt="a > b"><p>t</p>', "t"),
    ("<p>a</p><script>code()", "a"),
    ("a<!-- x", "a"),
    ("<p>ok</p><style>y", "ok"),
    ("1 < 2 <b>and</b> 3 > 2", "1 < 2 and 3 > 2"),
]


@pytest.mark.parametrize("html,expected", TEXTS)
def test_tags_golden(spark, html, expected):
    r = spark.createDataFrame([(html,)], "html string").select(H.page_text("html").alias("t"), H.visible_text("html").alias("v")).first()
    assert (r.t, r.v) == (expected, expected)


def test_title_golden(spark):
    rows = [("<!-- <title>old</title> --><title>new</title>", "new"), ("<title></title>", None), ("x", None), ('<title lang="a>b">T&amp;T</title>', "T&T")]
    got = spark.createDataFrame(rows, "html string, want string").select("want", H.page_title("html").alias("t")).collect()
    assert all(r.want == r.t for r in got)


class _Blocks(HTMLParser):
    """Texts of p, h1-h6 and li by a stack of open elements, nested blocks again."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.raw = [], [], 0

    def _pop(self, to):
        del self.stack[to:]

    def _index(self, tags):
        return max((i for i, (t, _) in enumerate(self.stack) if t in tags), default=-1)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.raw += 1
        heads = [f"h{k}" for k in range(1, 7)]
        if tag not in ("p", "li", "ul", "ol", "div", "nav", "article", "section", "footer", "header", "body", "html", "table", *heads):
            return
        if self._index(["p"]) > self._index(["table"]):
            self._pop(self._index(["p"]))
        if tag == "li" and self._index(["li"]) > self._index(["ul", "ol", "table"]):
            self._pop(self._index(["li"]))
        if tag in heads and self.stack and self.stack[-1][0] in heads:
            self.stack.pop()
        block = None
        if tag in ("p", "li", *heads):
            block = []
            self.blocks.append(block)
        self.stack.append((tag, block))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.raw = max(0, self.raw - 1)
        heads = [f"h{k}" for k in range(1, 7)]
        at = self._index(heads if tag in heads else [tag])
        if at >= 0:
            self._pop(at)

    def handle_data(self, data):
        if not self.raw:
            for _, block in self.stack:
                if block is not None:
                    block.append(data)


def test_block_text_matches_a_stack_walk(pages):
    """On the pages, and on each page nested in list items and sections."""
    wrap = F.concat(F.lit("<ul><li>top<div><section>"), "html", F.lit("</section></div><ul><li>sub</li></ul>tail</li><li>next<p>last</ul>"))
    for r in pages.select(H.block_text("html").alias("a"), "html", H.block_text(wrap).alias("b"), wrap.alias("wrapped")).collect():
        for got, source in ((r.a, r.html), (r.b, r.wrapped)):
            w = _Blocks()
            w.feed(source)
            w.close()
            assert got.split() == " ".join(" ".join(b) for b in w.blocks).split()


def test_clean_text_unicode_ws(spark):
    df = spark.createDataFrame([("  a \x1c b 　",)], "s string")
    assert df.select(H.clean_text("s").alias("c")).first().c == "a b"


def test_stray_angle_brackets_stay_linear(spark):
    """A text full of '<' without '>' (math, code) must not make tag matching quadratic."""
    import time

    html = "<p>" + "a < b " * 40000 + "</p>"
    df = spark.createDataFrame([(html,)], "html string")
    t0 = time.time()
    r = df.select(H.page_text("html").alias("t"), H.block_text("html").alias("b"), F.size(H.extract_hrefs("html")).alias("n")).first()
    assert time.time() - t0 < 20
    assert r.t.startswith("a < b a < b") and r.n == 0 and r.b.startswith("a < b")


def test_block_text_grows_with_the_page_alone(spark):
    """A page of 32,000 tags in seconds, and twice the page in about twice the time."""
    import time

    def seconds(n, unit="<li>item a text <p>b text</p>"):
        df = spark.range(1).select(F.repeat(F.lit(unit), n).alias("html")).filter("length(html) > 0")
        t = time.perf_counter()
        found = df.select(F.length(H.block_text("html")).alias("n")).collect()[0].n
        return found, time.perf_counter() - t

    seconds(100)
    size, once = seconds(8192)
    assert size == 26 * 8192 - 1 and once < 3
    size, twice = seconds(16384)
    assert size == 26 * 16384 - 1 and twice < 2.2 * once + 0.5
    assert seconds(2000, "<div><section><h2>x</h2>")[1] < 3  # 4,000 open elements


def test_blank_flag_is_empty_block_text(spark):
    import random

    rng = random.Random(11)
    bits = ["<p>", "</p>", "<li>", "<div>", "</div>", "<h2>", " ", " ", "&nbsp;", "&#32;", "&amp;", "x", "<b>", "<!--p-->", "<!-<!-- x -->- <p>y -->", "<script>p</script>", "<p class='a>b'>"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 7)))) for k in range(600)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "id long, html string")
    wrong = df.filter(H.without_block_text("html") != (F.coalesce(F.length(H.block_text("html")), F.lit(0)) == 0))
    assert wrong.collect() == []
