"""Streaming jobs over several micro-batches: visited state carries over, late rows drop."""

import tempfile

from pyspark.sql import functions as F

from pageflow.functions import urls as U
from pageflow.plans import fixtures as X
from pageflow.streaming import jobs as ST


def test_visited_upsert_across_batches(spark, sf_dir):
    pages = X.table(spark, sf_dir, "pages")
    src = tempfile.mkdtemp(prefix="pf-stream-src-")
    pages.filter("page_id % 2 = 0").coalesce(1).write.mode("overwrite").parquet(f"{src}/a")
    pages.filter("page_id % 2 = 1").coalesce(1).write.mode("overwrite").parquet(f"{src}/b")
    # one folder, two files, one file per micro-batch
    folder = tempfile.mkdtemp(prefix="pf-stream-in-")
    import glob
    import shutil

    for i, part in enumerate(sorted(glob.glob(f"{src}/a/*.parquet")) + sorted(glob.glob(f"{src}/b/*.parquet"))):
        shutil.copy(part, f"{folder}/part-{i}.parquet")
    empty = pages.limit(0).select(U.normalize_url("url").alias("url"))
    out = ST.visited_upsert_stream(spark, folder, empty, trigger={"availableNow": True})
    got_rows = ST.read_visited(spark, out).collect()
    got = {r.url for r in got_rows}
    assert len(got_rows) == len(got), "keys stay unique"
    exp = {r.k for r in pages.select(U.normalize_url("url").alias("k")).distinct().collect()}
    assert got == exp


def test_counters_drop_late_rows(spark, sf_dir):
    """Late-event filtering uses the watermark of the previous batch, so late rows arrive
    in the third micro-batch (one file per batch)."""
    import glob
    import shutil
    import time

    ev = X.table(spark, sf_dir, "events")
    folder = tempfile.mkdtemp(prefix="pf-events-")
    on_time = ev.filter("event_id < 500")
    late = on_time.limit(3).withColumn("ts", F.col("ts") - F.expr("INTERVAL 30 DAYS")).withColumn("event_type", F.lit("late"))
    on_time.filter("event_id < 250").coalesce(1).write.parquet(f"{folder}/0")
    on_time.filter("event_id >= 250").coalesce(1).write.parquet(f"{folder}/1")
    late.coalesce(1).write.parquet(f"{folder}/2")
    flat = tempfile.mkdtemp(prefix="pf-events-flat-")
    for i in range(3):
        for f in sorted(glob.glob(f"{folder}/{i}/*.parquet")):
            shutil.copy(f, f"{flat}/part-{i}.parquet")
            time.sleep(1.1)  # file streams order files by modification time
    out = ST.event_counters(spark, flat, max_files=1)
    got = spark.read.parquet(out)
    assert got.filter("event_type = 'late'").count() == 0
    assert got.agg(F.sum("n")).first()[0] == 500


def _page_files(spark, batches, schema):
    """One Parquet file per micro-batch, a second apart (file streams follow modification times)."""
    import glob
    import shutil
    import time

    folder = tempfile.mkdtemp(prefix="pf-arrivals-")
    for k, rows in enumerate(batches):
        part = tempfile.mkdtemp(prefix="pf-part-")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(part)
        shutil.copy(glob.glob(f"{part}/*.parquet")[0], f"{folder}/part-{k}.parquet")
        time.sleep(1.1)
    return folder


def test_dedup_across_batches_keeps_late_pages(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    batches = [[(1, "u", "a", day(10)), (2, "u", "b", day(10)), (3, "u", "a", day(10))], [(4, "u", "a", day(30)), (5, "u", "c", day(30))],
               [(6, "u", "late", day(1)), (7, "u", "b", day(60)), (8, "u", "d", day(60))]]
    folder = _page_files(spark, batches, "page_id long, url string, html string, fetched timestamp")
    whole = spark.read.parquet(ST.dedup_stream(spark, folder, max_files=1))
    assert sorted(r.h for r in whole.collect()) == sorted(spark.createDataFrame([(x,) for x in "abcd"] + [("late",)], "s string").select(F.md5("s").alias("h")).toPandas()["h"])
    bounded = spark.read.parquet(ST.dedup_stream(spark, folder, event_time="fetched", within="1 day", max_files=1))
    ids = {r.page_id for r in bounded.collect()}
    assert 6 not in ids and {2, 5, 8} <= ids  # 6 is later than the watermark


FETCHED = "url string, ts timestamp, status int, batch_no int"


def _day(n):
    import datetime as dt

    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def _latest(rows):
    out = {}
    for url, ts, status, batch_no in rows:
        out[url] = max(out.get(url, (-1,)), (batch_no, ts, status))
    return {u: (w[1], w[2], w[0]) for u, w in out.items()}


def test_upsert_stream_is_the_batch_upsert(spark, tmp_path):
    """Updates, new URLs, rows later than what is held, ties, a repeated row, and a batch that comes again."""
    from pageflow.operators import dedup as D

    start = [(f"u{k}", _day(0), 1, 0) for k in range(40)]
    batches = [
        [(f"u{k}", _day(2), 0, 1) for k in range(0, 40, 4)] + [("new1", _day(1), 1, 1)],
        [(f"u{k}", _day(1), 1, 1) for k in range(0, 40, 8)] + [("u1", _day(9), 0, 0), ("u1", _day(9), 1, 0)],  # late, ties
        [("new1", _day(0), 0, 3), ("new2", _day(0), 1, 3), ("new2", _day(0), 1, 3)],
        [("u4", _day(0), 1, 9)],
    ]
    folder = _page_files(spark, batches, FETCHED)
    table = ST.crawled_table(spark, f"{tmp_path}/table", buckets=7)
    table.merge(spark.createDataFrame(start, FETCHED), -1)
    ST.upsert_stream(spark, folder, table, f"{tmp_path}/checkpoint", max_files=1)
    every = start + [r for b in batches for r in b]
    read = lambda v=None: {r.url: (r.ts, r.status, r.batch_no) for r in table.read(v).collect()}
    assert read() == _latest(every) and table.read().count() == len(read())
    whole = D.upsert_crawled(spark.createDataFrame(start, FETCHED), spark.createDataFrame(every[len(start):], FETCHED))
    assert {r.url: (r.ts, r.status, r.batch_no) for r in whole.collect()} == read()
    assert table.batch() == 3 and table.version() == 4
    # a batch that is delivered again after its commit changes nothing
    assert not table.merge(spark.createDataFrame([("u4", _day(0), 0, 99)], FETCHED), 3)
    assert read() == _latest(every)
    # only touched buckets are rewritten, and every version can be read until it is cleaned up
    before, after = (table.commits.read(v)["folders"] for v in (3, 4))
    assert sum(before[b] != after[b] for b in after) == 1
    assert read(0) == _latest(start) and read(2) == _latest(start + batches[0] + batches[1])
    assert table.vacuum(keep=1) > 0 and read() == _latest(every) and table.commits.numbers() == [4]
    assert table.merge(spark.createDataFrame([("u4", _day(0), 0, 99)], FETCHED), 4) and read()["u4"] == (_day(0), 0, 99)


def test_a_merge_that_fails_before_its_commit_is_done_again(spark, tmp_path, monkeypatch):
    import pytest

    from pageflow.sources.commits import CommitLog

    table = ST.crawled_table(spark, f"{tmp_path}/table", buckets=3)
    rows = [("a", _day(0), 1, 0), ("b", _day(0), 1, 0)]
    table.merge(spark.createDataFrame(rows, FETCHED), 0)
    update = spark.createDataFrame([("a", _day(1), 0, 1)], FETCHED)
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.merge(update, 1)
    assert {r.url: r.status for r in table.read().collect()} == {"a": 1, "b": 1}
    again = ST.crawled_table(spark, f"{tmp_path}/table", buckets=99)  # a new driver; the buckets are the table's
    assert again.buckets == 3 and again.merge(update, 1)
    assert {r.url: r.status for r in again.read().collect()} == {"a": 0, "b": 1}
    with pytest.raises(RuntimeError):
        again.commits.commit(1, {})


def test_empty_versioned_table(spark, tmp_path):
    table = ST.crawled_table(spark, f"{tmp_path}/table")
    assert table.read().count() == 0 and table.batch() is None
    assert table.merge(spark.createDataFrame([], FETCHED), 0) and table.read().count() == 0
    one = spark.createDataFrame([(None, None, None, None), ("x", None, 1, 1)], FETCHED)
    assert table.merge(one, 1) and {r.url for r in table.read().collect()} == {None, "x"}
    assert table.vacuum(keep=1) >= 0 and table.read().count() == 2


def test_link_stream_delivers_once(spark, sf_dir, tmp_path, monkeypatch):
    """A batch fails after its outputs are written, the query starts again, and each row is there once."""
    import pytest

    from pageflow.functions import html as H
    from pageflow.operators import links as L
    from pageflow.sources.versioned import VersionedTable

    pages = X.table(spark, sf_dir, "pages").filter("page_id < 60")
    pages.repartitionByRange(3, "page_id").write.parquet(f"{tmp_path}/in")
    seen = L.link_edges(pages.filter("page_id % 5 = 0")).select("host", F.col("dst").alias("url"))
    sink = ST.LinkSink(spark, f"{tmp_path}/out", buckets=5)
    sink.start(seen)
    merge = VersionedTable.merge

    def fails(self, rows, batch_id):
        if batch_id == 1:
            raise RuntimeError("lost")
        return merge(self, rows, batch_id)

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "merge", fails)
        with pytest.raises(Exception, match="lost"):
            ST.link_stream(spark, f"{tmp_path}/in", sink, f"{tmp_path}/check", max_files=1)
    assert sink.seen.batch() == 0
    ST.link_stream(spark, f"{tmp_path}/in", sink, f"{tmp_path}/check", max_files=1)
    sink.start(seen)  # ignored
    assert sink.seen.batch() == 2
    edges = ["page_id", "host", "src", "dst", "pos"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sink.read("edges").select(*edges)) == rows(L.link_edges(pages).select(*edges))
    assert rows(sink.read("text").select("page_id", "text")) == rows(pages.select("page_id", H.page_text("html")))
    from pageflow.operators import dedup as D

    new = D.unseen(L.link_edges(pages).select("host", F.col("dst").alias("url")), seen, ["host", "url"]).distinct()
    assert rows(sink.read("frontier").select("host", "url")) == rows(new) != []
    assert rows(sink.seen.read()) == rows(seen.unionByName(new).distinct())


def test_tables_in_parts_are_streamed_whole(spark, tmp_path):
    """A table is a folder called pages.parquet: every part is read, as from a table that is one file."""
    import glob
    import shutil

    from pageflow.plans.catalog import QUERIES

    html = [f'<p>page {k}</p><a href="/a{k % 4}">x</a><a href="http://b.c/">y</a>' for k in range(40)]
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/p{k % 30}/", t) for k, t in enumerate(html)], "page_id long, url string, html string")
    pages.repartition(5).write.parquet(f"{tmp_path}/parts/pages.parquet")
    pages.coalesce(1).write.parquet(f"{tmp_path}/one")
    (tmp_path / "single").mkdir()
    shutil.copy(glob.glob(f"{tmp_path}/one/*.parquet")[0], f"{tmp_path}/single/pages.parquet")
    assert len(glob.glob(f"{tmp_path}/parts/pages.parquet/*.parquet")) == 5
    for name, n in (("stream_ingest", 40), ("stream_visited", len({(k % 3, k % 30) for k in range(40)}))):
        parts, single = (sorted(map(tuple, QUERIES[name][0](spark, f"{tmp_path}/{d}").collect())) for d in ("parts", "single"))
        assert parts == single and len(parts) == n


def test_a_batch_of_one_file_is_dealt_over_all_tasks(spark, tmp_path, monkeypatch):
    """Links of a large file are extracted by as many tasks as the session has partitions, not by the file's one."""
    from pageflow.operators import links as L

    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/p{k}", f'<a href="/a{k % 7}">x</a>') for k in range(400)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/in")
    dealt, extract = [], L.link_edges
    with monkeypatch.context() as m:
        m.setattr(L, "link_edges", lambda df, *a: dealt.append(df.select(F.spark_partition_id()).distinct().count()) or extract(df, *a))
        sink = ST.LinkSink(spark, f"{tmp_path}/out", buckets=3)
        ST.link_stream(spark, f"{tmp_path}/in", sink, f"{tmp_path}/check")
    assert dealt == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    order = ["page_id", "host", "src", "dst", "pos"]
    assert sorted(map(tuple, sink.read("edges").select(*order).collect())) == sorted(map(tuple, extract(pages).select(*order).collect()))
