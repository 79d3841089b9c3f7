"""Stdlib differential tests for the URL column functions."""

import hashlib
import random
import re
from pathlib import Path
from urllib.parse import unquote, urljoin, urlparse

from pyspark.sql import functions as F

from pageflow.functions import urls as U

BASES = ["https://e.com", "https://e.com/", "https://e.com/a/b", "https://e.com/a/b/", "http://E.com:8080/x;p?q=1#f",
         "https://e.com/a/b/c.html?x=1"]
REFS = ["", "#t", "?q=2", "c", "c/", "./c", "../c", "../../../c", "/a/../b//", "/p;x=1?q#f", "//o.com/x",
        "HTTPS://E.com/A", "mailto:a@b", "javascript:void(0)", "tel:123", "c//d/./e/..", ".", "..", "a/./b/../",
        "https://e.com/x/", "/", "//", "/.env", "x;y/z;w", "http://e.com/q", " /a b ", "\t//o.com/x\n", " \x01mailto:x",
        "/p\ta\rth", "  ", "\n"]


def py_normalize(base, ref):
    url = urljoin(base, ref)
    p = urlparse(url)
    return f"{p.scheme}://{p.netloc}{p.path}".rstrip("/")


def test_resolve_and_normalize_match_urllib(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(rows, "base string, ref string")
    got = df.select("base", "ref", U.normalize_url("ref", "base").alias("n")).collect()
    bad = [(r.base, r.ref, r.n, py_normalize(r.base, r.ref)) for r in got if r.n != py_normalize(r.base, r.ref)]
    assert not bad, bad[:10]


def test_parts_match_urlparse(spark):
    urls = [b for b in BASES] + ["HTTP://X.org", "a b|c", "https://h/p;q/r;s", "//h/p", "mailto:x@y", "/rel?x#y", " \thttps://h/a\nb "]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select("u", U.url_parts("u").alias("p")).collect()
    for r in got:
        p = urlparse(r.u)
        assert (r.p.scheme, r.p.netloc, r.p.path, r.p.params, r.p.query, r.p.fragment) == tuple(p), r.u


def test_suffix_matches_pathlib(spark):
    rng = random.Random(7)
    alphabet = "ab./."
    paths = ["/" + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8))) for _ in range(2000)]
    paths += ["/a.", "/x.pdf/", "/v1.2/", "/.env", "/x.pdf/.", "/a..b", "/x.tar.gz", "", "/x.PDF"]
    df = spark.createDataFrame([("https://e.com" + p,) for p in paths], "u string")
    got = df.select("u", U.url_suffix("u").alias("s")).collect()
    bad = [(r.u, r.s) for r in got if r.s != Path(urlparse(r.u).path).suffix.lower()]
    assert not bad, bad[:10]


def test_golden_suffix_modes(spark):
    cases = [("https://example.com", "", ".com"), ("https://e.com/a?f=x.pdf", "", ".pdf"),
             ("https://e.com/x.pdf?y=1", ".pdf", ".pdf?y=1"), ("https://e.com/.env", "", ""),
             ("https://e.com/a.", "", ""), ("https://e.com/x.pdf/", ".pdf", ".pdf"), ("https://e.com/v1.2/", ".2", ".2")]
    df = spark.createDataFrame([(c[0],) for c in cases], "u string")
    got = {r.u: (r.p, r.r) for r in df.select("u", U.url_suffix("u").alias("p"), U.url_suffix("u", "raw").alias("r")).collect()}
    for u, p, r in cases:
        assert got[u] == (p, r), u


def test_categories(spark):
    df = spark.createDataFrame([("https://e.com/a.PDF",), ("https://e.com/a.xyz",), ("https://e.com/a",),
                                ("https://e.com/a.html",), ("https://example.com",)], "u string")
    got = df.select(U.file_category("u").alias("c"), U.file_category("u", "narrow").alias("n"),
                    U.file_category("u", mode="raw").alias("r")).collect()
    assert [tuple(r) for r in got] == [("document", "document", "document"), ("other", "other", "other"),
                                       (None, None, None), ("code", "other", "code"), (None, None, "other")]


def test_sanitize_and_unquote(spark):
    urls = ["https://e.com/a b/é?x=1&y=%20", "https://e.com/" + "x" * 300, "https://e.com/%zz%41", "https://e.com/a+b%2Fc"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select("u", U.sanitize_filename("u").alias("s"), U.sanitize_filename("u", "long").alias("l"),
                    U.unquote("u").alias("q")).collect()
    valid = set("-_.() abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    for r in got:
        short = "".join(c for c in r.u[:50] if c in valid) + "_" + hashlib.md5(r.u.encode()).hexdigest()
        assert r.s == short.rstrip(".")
        name = re.sub(r"[^\w\-_.]", "_", r.u)
        if len(name) > 200:
            name = name[:150] + "_" + hashlib.md5(r.u.encode()).hexdigest()[:10]
        assert r.l == name
    assert got[0].q == unquote(urls[0])
    assert got[3].q == unquote(urls[3])


def test_random_references_match_urljoin(spark):
    """Seeded random base x reference pairs built from URL-significant pieces."""
    rng = random.Random(11)
    pieces = ["a", "b", "..", ".", "", "x.html", ";p=1", "?q=1", "#f", "//", "%41", " ", "c d"]

    def ref():
        head = rng.choice(["", "/", "//h.org/", "./", "../", "https://e.com/", "mailto:"])
        return head + "/".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))

    def base():
        return "https://e.com" + "".join(rng.choice(["/a", "/b/", "/c.html", "/..", "/d;x", "?z=1"]) for _ in range(rng.randint(0, 4)))

    rows = [(base(), ref()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "base string, ref string")
    got = df.select("base", "ref", U.normalize_url("ref", "base").alias("n")).collect()
    bad = [(r.base, r.ref, r.n, py_normalize(r.base, r.ref)) for r in got if r.n != py_normalize(r.base, r.ref)]
    assert not bad, bad[:10]
