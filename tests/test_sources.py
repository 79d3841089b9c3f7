"""Sources and sinks (S2-S8): binary files, robots/sitemaps edge cases, writer round trips."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from pageflow.plans import fixtures as X
from pageflow.sources import io as S


def test_read_files_metadata_only(spark, sf_dir):
    d = tempfile.mkdtemp(prefix="pf-files-")
    pages = X.table(spark, sf_dir, "pages").select("page_id", "html").orderBy("page_id").limit(5).collect()
    for r in pages:
        with open(os.path.join(d, f"p{r.page_id}.html"), "w", encoding="utf-8") as fh:
            fh.write(r.html)
    df = S.read_files(spark, d, glob="*.html")
    assert df.columns == ["path", "length", "modificationTime"]
    got = {os.path.basename(r.path): r.length for r in df.collect()}
    assert got == {f"p{r.page_id}.html": len(r.html.encode("utf-8")) for r in pages}
    assert "content" in S.read_files(spark, d, with_content=True).columns


def test_robots_lines(spark):
    df = spark.createDataFrame([("h", "User-agent: *\r\nSITEMAP:  https://h/s1.xml \nsitemap:https://h/a:b\nAllow: /\n# Sitemap: no")],
                               "host string, text string")
    got = sorted(r.sitemap_url for r in S.sitemaps_from_robots(df).collect())
    assert got == ["https://h/a:b", "https://h/s1.xml"]


def test_sitemap_guards(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    rows = [
        ("ok", f"<urlset {ns}><url><loc> https://a/1 </loc></url><url><loc>https://a/2</loc></url></urlset>", "application/xml"),
        ("bad", f"<urlset {ns}><url><loc>https://b/1</lo", "application/xml"),
        ("text", f"<urlset {ns}><url><loc>https://c/1</loc></url></urlset>", "text/plain"),
        ("prefix", '<?xml version="1.0"?><s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc> https://p/1</s:loc></s:url></s:urlset>', "application/xml"),
        ("foreign", '<x:urlset xmlns:x="http://other.org/"><x:url><x:loc>https://f/1</x:loc></x:url></x:urlset>', "application/xml"),
        ("none", "<urlset><url><loc>https://n/1</loc></url></urlset>", "application/xml"),
        ("cdata", f"<urlset {ns}><url><loc>\n<![CDATA[https://e/1?a=1&b=2]]>\n</loc></url></urlset>", "application/xml"),
        ("index", f"<sitemapindex {ns}><sitemap><loc>https://d/s.xml</loc></sitemap></sitemapindex>", "text/xml"),
    ]
    df = spark.createDataFrame(rows, "host string, xml string, content_type string")
    got = sorted((r.host, r.url) for r in S.urls_from_sitemap(df).collect())
    assert got == [("cdata", "https://e/1?a=1&b=2"), ("ok", "https://a/1"), ("ok", "https://a/2"), ("prefix", "https://p/1")]


def test_writers_round_trip(spark, sf_dir):
    base = tempfile.mkdtemp(prefix="pf-sinks-")
    f = X.fetches(X.table(spark, sf_dir, "pages"))
    recs = f.select("host", F.md5("url").alias("key"), F.col("url").alias("text"))
    p = S.write_text(recs, f"{base}/text")
    back = spark.read.parquet(p)
    assert back.count() == recs.count() and set(back.columns) == {"host", "key", "text"}
    meta = f.select("host", "url", "status_code", "content_type")
    p = S.write_metadata(meta, f"{base}/meta")
    rows = spark.read.text(p).collect()
    assert len(rows) == meta.count()
    doc = json.loads(rows[0].value)
    assert set(doc) == {"host", "url", "status_code", "content_type"}
    stats = f.groupBy("host").agg(F.count("*").alias("pages"))
    p = S.write_stats(stats, f"{base}/stats")
    assert spark.read.json(p).agg(F.sum("pages")).first()[0] == f.count()


def test_number_of_files_is_bounded(spark):
    """Thousands of sites, one with a third of the records, in four files of similar size."""
    import glob

    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), "id")).alias("host"), F.md5(F.col("id").cast("string")).alias("key"), F.lit("x").alias("text"))
    p = S.write_text(rows.repartition(16), tempfile.mkdtemp(prefix="pf-files-") + "/t", files=4)
    files = glob.glob(f"{p}/*.parquet")
    assert len(files) == 4
    counts = [spark.read.parquet(f).count() for f in files]
    assert sum(counts) == 9000 and max(counts) < 4500


def _sitemap_cases():
    """(name, document): well-formed ones of every prefix, odd ones, and malformed ones."""
    ns = f'xmlns="{S.SITEMAP_NS}"'
    doc = lambda body, attr=ns: f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset {attr}>{body}</urlset>'
    u = "<url><loc>https://e.com/a?x=1&amp;y=2</loc></url>"
    more = "<url>\n <lastmod>2024-01-01</lastmod><loc> https://e.com/b\n</loc><priority>0.5</priority>\n</url>\n"
    pre = (u + more).replace("<", "<s:").replace("<s:/", "</s:")
    return {
        "plain": doc(u + more + u), "one": doc(u), "prefix": doc(pre, f'xmlns:s="{S.SITEMAP_NS}"').replace("urlset", "s:urlset"),
        "none": doc(""), "no_loc": doc("<url><lastmod>x</lastmod></url>"), "cdata": doc("<url><loc><![CDATA[https://e.com/c]]></loc></url>" + u),
        "comment": doc("<!-- <loc>no</loc> -->" + u), "attribute": doc('<url><loc a="1">https://e.com/d</loc></url>' + u), "number": doc("<url><loc>https://e.com/&#65;</loc></url>"),
        "image": doc(u + '<url><loc>https://e.com/e</loc><i:image xmlns:i="urn:i"><i:loc>https://e.com/i.png</i:loc></i:image></url>'), "empty_loc": doc("<url><loc></loc></url>" + u),
        "cut": doc(u + more)[:-20], "cut_value": doc(u + more)[:120], "crossed": doc("<url><loc>https://e.com/x</url></loc>"), "mixed": doc(u + pre), "entity": doc("<url><loc>https://e.com/&nbsp;</loc></url>"),
        "lone_amp": doc("<url><loc>https://e.com/?a&b</loc></url>"), "foreign": doc(u, 'xmlns="urn:other"'), "index": doc(u).replace("urlset", "sitemapindex"), "two_urls": doc("<url><loc>https://e.com/1</loc><loc>https://e.com/2</loc></url>"),
        "behind": doc(u) + "<p>", "before": "x" + doc(u), "space": doc(u) + "\n \n", "blank": "", "text": "loc>loc>", "unclosed": doc(u.replace("</url>", "")), "slash": doc(u.replace("</loc>", "</ loc>")),
    }


def test_sitemap_files_give_what_whole_documents_give(spark, tmp_path):
    from pageflow.sources.sitemaps import urls_from_sitemap_files

    cases = _sitemap_cases()
    for name, text in cases.items():
        (tmp_path / f"{name}.xml").write_text(text)
    rows = [(f"{n}.xml", n, "Application/XML", t) for n, t in cases.items()]
    (tmp_path / "html.xml").write_text(cases["plain"])
    docs = spark.createDataFrame(rows + [("html.xml", "html", "text/html", cases["plain"])], "doc string, host string, content_type string, xml string")
    got = sorted(map(tuple, urls_from_sitemap_files(spark, str(tmp_path), docs.drop("xml")).collect()))
    want = sorted(map(tuple, S.urls_from_sitemap(docs).select("host", "url").collect()))
    assert got == want
    hosts = {h for h, _ in got}
    assert {"plain", "prefix", "image", "cdata"} <= hosts and not hosts & {"cut", "crossed", "lone_amp", "foreign", "html"}


def test_a_sitemap_of_a_million_urls_is_read_by_several_tasks(spark, tmp_path):
    from pageflow.sources.sitemaps import sitemap_pieces, urls_from_sitemap_files

    with open(tmp_path / "big.xml", "w") as f:
        f.write(f'<urlset xmlns="{S.SITEMAP_NS}">')
        for k in range(0, 1_000_000, 1000):
            f.write("".join(f"<url><loc>https://e.com/{i}?a=1&amp;b</loc></url>\n" for i in range(k, k + 1000)))
        f.write("</urlset>")
    pieces = sitemap_pieces(spark, str(tmp_path))
    assert pieces.select("block").distinct().count() >= 4
    docs = spark.createDataFrame([("big.xml", "e.com", "text/xml")], "doc string, host string, content_type string")
    got = urls_from_sitemap_files(spark, str(tmp_path), docs)
    ids = got.select(F.regexp_extract("url", r"^https://e\.com/(\d+)\?a=1&b$", 1).cast("long").alias("i"))
    assert ids.agg(F.count("i"), F.count_distinct("i"), F.min("i"), F.max("i")).first()[:] == (1_000_000, 1_000_000, 0, 999_999)
