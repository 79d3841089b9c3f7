"""Crawl (K1-K6) against a sequential FIFO crawler simulation, plus invariants."""

import hashlib
from collections import defaultdict, deque
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from pageflow.operators import crawl as K
from pageflow.plans import fixtures as X


def simulate(seeds, edges, keys, max_pages=0, max_depth=0):
    """The reference loop, one site at a time: pop FIFO while discovered < max_pages; absent pages,
    files and duplicate bodies expand nothing; links in position order. (depth, rank, status) per URL."""
    out = {}
    links = defaultdict(list)
    for host, src, dst, pos in sorted(edges, key=lambda e: (e[0], e[1], e[3], e[2])):
        links[(host, src)].append(dst)
    for host, seed in seeds:
        seen = {seed: 0}
        queue = deque([seed])
        status = {}
        hashes = set()
        while queue and (not max_pages or len(seen) < max_pages):
            url = queue.popleft()
            d, h = seen[url], keys.get((host, url))
            if h is None:
                status[url] = "failed"
                continue
            if url.endswith((".zip", ".pdf")):
                status[url] = "file"
                continue
            if max_depth and d > max_depth:
                status[url] = "skipped"
                continue
            if h in hashes:
                status[url] = "duplicate"
                continue
            hashes.add(h)
            status[url] = "processed"
            for dst in links[(host, url)]:
                if dst not in seen:
                    seen[dst] = d + 1
                    queue.append(dst)
        for rank, (url, d) in enumerate(seen.items(), 1):
            out[(host, url)] = (d, rank, status.get(url, "skipped"))
    return out


@pytest.fixture(scope="module")
def graph(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages")
    # duplicate bodies: every 7th page repeats the body of the page before it
    prev = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("html").alias("prev_html"))
    dup_pages = pages.join(prev, "page_id", "left").select(
        "page_id", "url", F.when((F.col("page_id") % 7 == 0) & F.col("prev_html").isNotNull(), F.col("prev_html")).otherwise(F.col("html")).alias("html"))
    seeds = X.tree_seeds(pages)
    edges = X.site_tree(pages)
    return pages, dup_pages, seeds, edges


def _keys(pages):
    """Body hash by (host, key) with the standard library; the first page of a key counts."""
    out = {}
    for r in sorted(pages.collect(), key=lambda r: r.page_id):
        u = urlparse(r.url)
        out.setdefault((u.netloc, f"{u.scheme}://{u.netloc}{u.path}".rstrip("/")), hashlib.md5(r.html.encode()).hexdigest())
    return out


def _edges(edges):
    return [tuple(r) for r in edges.select("host", "src", "dst", "pos").collect()]


@pytest.mark.parametrize("max_pages,max_depth,use_dups", [(0, 0, False), (12, 0, True), (0, 2, True)])
def test_crawl_matches_sequential_simulation(graph, max_pages, max_depth, use_dups):
    pages, dup_pages, seeds, edges = graph
    p = dup_pages if use_dups else pages
    got = K.crawl_reach(seeds, edges, p, max_depth=max_depth, max_pages=max_pages).collect()
    exp = simulate([tuple(r) for r in seeds.collect()], _edges(edges), _keys(p), max_pages, max_depth)
    got_map = {(r.host, r.url): (r.depth, r.rank, r.status) for r in got}
    assert len(got) == len(got_map), "discovered URLs must be unique"
    assert got_map == exp


@pytest.mark.parametrize("max_pages,max_depth", [(0, 0), (4, 0), (0, 1)])
def test_every_status(spark, sf_dir, max_pages, max_depth):
    """Absent pages, files and repeated bodies on the way."""
    pages = X.table(spark, sf_dir, "pages")
    seeds, edges, snapshot = X.tree_seeds(pages), X.crawl_tree(pages), X.crawl_pages(pages)
    got = K.crawl_reach(seeds, edges, snapshot, max_depth=max_depth, max_pages=max_pages).collect()
    exp = simulate([tuple(r) for r in seeds.collect()], _edges(edges), _keys(snapshot), max_pages, max_depth)
    assert {(r.host, r.url): (r.depth, r.rank, r.status) for r in got} == exp
    assert {r.status for r in got} >= {"processed", "failed", "file", "duplicate"} | ({"skipped"} if max_pages or max_depth else set())


def test_long_chains_are_followed_to_the_end(spark):
    """The loop ends on an empty frontier and nothing else."""
    pages = spark.createDataFrame([(k, f"https://e.com/{k}", f"body {k}") for k in range(9)], "page_id long, url string, html string")
    edges = spark.createDataFrame([("e.com", f"https://e.com/{k}", f"https://e.com/{k + 1}", 0) for k in range(8)], "host string, src string, dst string, pos int")
    seeds = spark.createDataFrame([("e.com", "https://e.com/0")], "host string, url string")
    got = K.crawl_reach(seeds, edges, pages)
    assert sorted(r.depth for r in got.collect()) == list(range(9))


def test_reach_depth_is_minimal_and_ranks_dense(graph):
    pages, _d, seeds, edges = graph
    r = K.crawl_reach(seeds, edges, pages)
    # every edge from a processed page leads to a URL no deeper than depth + 1
    e = edges.alias("e").join(r.alias("a"), (F.col("e.host") == F.col("a.host")) & (F.col("e.src") == F.col("a.url")))
    e = e.join(r.alias("b"), (F.col("e.host") == F.col("b.host")) & (F.col("e.dst") == F.col("b.url")))
    assert e.filter((F.col("a.status") == "processed") & (F.col("b.depth") > F.col("a.depth") + 1)).count() == 0
    ranks = r.groupBy("host").agg(F.count("*").alias("n"), F.max("rank").alias("mx"), F.count_distinct("rank").alias("d"))
    assert ranks.filter((F.col("n") != F.col("mx")) | (F.col("n") != F.col("d"))).count() == 0


def test_batches_and_schedule(spark, sf_dir):
    f = X.fetches(X.table(spark, sf_dir, "pages")).select("page_id", "host")
    s = K.fetch_schedule(f, 4, 0.5, ["host"], ["page_id"]).collect()
    by_host = defaultdict(list)
    for r in s:
        by_host[r.host].append(r)
    for rows in by_host.values():
        rows.sort(key=lambda r: r.page_id)
        for i, r in enumerate(rows):
            assert r.seq == i + 1 and r.batch == i // 4 and r.offset_s == (i // 4) * 0.5


def _chain(spark, n):
    pages = spark.range(n).selectExpr("id AS page_id", "concat('https://e.com/', id) AS url", "concat('body ', id) AS html")
    edges = spark.range(n - 1).selectExpr("'e.com' AS host", "concat('https://e.com/', id) AS src", "concat('https://e.com/', id + 1) AS dst", "0 AS pos")
    return spark.createDataFrame([("e.com", "https://e.com/0")], "host string, url string"), edges, pages


class Lost(Exception):
    pass


@pytest.mark.parametrize("limits", [{}, {"max_pages": 12}, {"max_depth": 3}])
def test_a_lost_driver_starts_again_from_the_last_whole_level(spark, sf_dir, tmp_path, monkeypatch, limits):
    """The driver is lost while level 3 is written (its files are there, its commit isn't), and again at a later level."""
    pages = X.table(spark, sf_dir, "pages")
    seeds, edges, snapshot = X.tree_seeds(pages), X.crawl_tree(pages), X.crawl_pages(pages)
    log, commit = f"{tmp_path}/crawl", K.CommitLog.commit

    def lost_at(level):
        def fail(self, number, content):
            if number == level:
                raise Lost
            commit(self, number, content)

        return fail

    ran = []
    for level in (3, 4):
        monkeypatch.setattr(K.CommitLog, "commit", lost_at(level))
        try:
            K.crawl_reach(seeds, edges, snapshot, log=log, **limits)
        except Lost:
            ran.append(K.LevelLog(spark, log, {"max_depth": 0, "max_pages": 0, "dedup": True, "html_as_page": True} | limits).depth)
    monkeypatch.setattr(K.CommitLog, "commit", commit)
    assert ran and ran[0] == 2
    got = K.crawl_reach(seeds, edges, snapshot, log=log, **limits).collect()
    exp = simulate([tuple(r) for r in seeds.collect()], _edges(edges), _keys(snapshot), **limits)
    assert {(r.host, r.url): (r.depth, r.rank, r.status) for r in got} == exp and len(got) == len(exp)
    again = K.crawl_reach(seeds, edges.limit(0), snapshot.limit(0), log=log, **limits).collect()  # it had ended: nothing is read
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    with pytest.raises(ValueError):
        K.crawl_reach(seeds, edges, snapshot, log=log, dedup=False, **limits)


def test_growing_tables_stay_compact(spark):
    """200 additions: no bucket has more than FAN files per tier, and no row is lost or doubled."""
    import re
    from collections import Counter

    from pageflow.operators import state

    held = state.Growing(spark, ["host", "url"])
    most = 0
    for k in range(200):
        held.add(spark.range(k * 3, k * 3 + 3).selectExpr("'e' AS host", "CAST(id AS string) AS url"), 3)
        files = Counter((i, re.search(r"_(\d{5})\.c", f).group(1)) for i, t in enumerate(held.tables()) for f in t.inputFiles())
        most = max(most, *files.values())
    assert most <= state.FAN and len(held.tiers) == 3
    rows = [r.url for t in held.tables() for r in t.collect()]
    assert sorted(map(int, rows)) == list(range(600))
    asked = spark.range(590, 610).selectExpr("'e' AS host", "CAST(id AS string) AS url")
    assert sorted(int(r.url) for r in held.lacking(asked).collect()) == list(range(600, 610))
    held.forget()


def test_a_chain_over_many_levels(spark):
    """More levels than a tier takes."""
    seeds, edges, pages = _chain(spark, 20)
    got = K.crawl_reach(seeds, edges, pages).collect()
    assert sorted((r.depth, r["rank"], r.status) for r in got) == [(k, k + 1, "processed") for k in range(20)]


def test_a_level_shuffles_only_the_frontier(spark, graph):
    """No Exchange between a join and the tables of keys, links and seen URLs (two tiers)."""
    pages, _dups, seeds, edges = graph
    keys = K.Bucketed(spark, ["host", "url"]).add(K.page_keys(pages))
    links = K.Bucketed(spark, ["host", "src"]).add(edges.select("host", "src", "dst", "pos"))
    frontier = seeds.withColumn("ord", F.monotonically_increasing_id())
    seen = K.Growing(spark, ["host", "url"], fan=2)
    for _ in range(3):
        seen.add(frontier.select("host", "url"), 10)
    assert len(seen.tables()) == 2
    f = K.level_frontier(frontier, keys.rows()).withColumn("expands", F.lit(True))
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        lines = K.level_links(f, links.rows(), seen.tables())._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    indent = lambda x: len(x) - len(x.lstrip(" :+-"))
    scans = [i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x]
    assert len(scans) == 4
    for i in scans:
        level = indent(lines[i])
        for x in reversed(lines[:i]):
            if indent(x) < level:
                level = indent(x)
                assert "Exchange" not in x, x
                if "Join" in x:
                    break
    for table in (keys, links, seen):
        table.forget()


def test_small_levels_write_no_buckets(spark, monkeypatch):
    """The last levels are read from the level log: growing tables get rows only when there are many. The result is the same."""
    seeds, edges, pages = _chain(spark, 6)
    added, add = [], K.Growing.add
    monkeypatch.setattr(K.Growing, "add", lambda self, df, rows=None: added.append(rows) or add(self, df, rows))
    rows = lambda: sorted(map(tuple, K.crawl_reach(seeds, edges, pages).collect()))
    small = rows()
    assert added == [] and len(small) == 6
    monkeypatch.setattr(K, "RECENT_ROWS", 1)
    assert rows() == small and len(added) > 2
