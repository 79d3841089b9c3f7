"""Structured Streaming jobs (ST1-ST4): the crawler's online checks as stateful streams.

Each job reads a file stream, runs with a trigger chosen by the caller
(``availableNow`` in tests and the registered queries) and writes to a sink under a
folder of the shared checkpoint directory, so a restarted query resumes from its
checkpoint. Sinks are idempotent per batch id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.functions import html as H
from pageflow.functions import urls as U
from pageflow.operators import links as L
from pageflow.operators.dedup import content_hash
from pageflow.session import checkpoint_dir
from pageflow.sources.commits import file_system
from pageflow.sources.versioned import VersionedTable


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream's sink and checkpoint inside the shared checkpoint dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _run(writer, trigger: dict) -> None:
    q = writer.trigger(**trigger).start()
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover - surfaced to the caller
        raise q.exception()


def ntz_to_instant(c: str) -> F.Column:
    """A wall-clock TIMESTAMP_NTZ read as UTC, as an event-time TIMESTAMP (session-TZ free)."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")
    return F.timestamp_micros(micros)


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A parquet file stream. ``path`` is a directory, whatever its name (a table in parts is often called
    ``x.parquet`` too), or one file (then its folder is watched for files of that name pattern)."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    fs, at = file_system(spark, path)
    if fs.exists(at) and fs.getFileStatus(at).isFile():
        folder, name = path.rsplit("/", 1)
        return r.option("pathGlobFilter", name).parquet(folder)
    return r.parquet(path)


def ingest_pages(spark: SparkSession, path: str, out: str | None = None, trigger: dict | None = None) -> str:
    """ST1: stateless page ingest: text (H3) and in-site link count (H12) per page, appended
    to a parquet sink. Returns the sink path."""
    out = out or scratch(spark, "ingest")
    s = file_stream(spark, path)
    host = U.url_netloc("url")
    items = F.transform(H.extract_hrefs("html"), lambda h: U.normalize_url(h, F.col("url")))
    links = F.array_distinct(F.filter(items, lambda x: U.is_valid_url(x, host)))
    rows = s.select("page_id", H.page_text("html").alias("text"), F.size(links).cast("long").alias("n_links"))
    w = rows.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/_checkpoint").outputMode("append")
    _run(w, trigger or {"availableNow": True})
    return f"{out}/data"


def dedup_stream(spark: SparkSession, path: str, out: str | None = None, trigger: dict | None = None,
                 event_time: str | None = None, within: str | None = None, max_files: int | None = None) -> str:
    """ST2: content de-dup while pages arrive: one row per body hash, the first that arrives.

    By default every page counts, however late, and a hash is remembered for good: the state (16 bytes of
    hash per distinct body; RocksDB on a cluster) grows with the distinct bodies. With ``event_time`` (the
    stream's fetch-time column) and ``within``, hashes are forgotten behind the watermark: bounded state, but
    a page that is later than that is dropped and a body that comes back after it is kept again.
    """
    out = out or scratch(spark, "dedup")
    s = file_stream(spark, path, max_files)
    keyed = s.select("page_id", content_hash("html").alias("h"), *([event_time] if event_time else []))
    if event_time and within:
        firsts = keyed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["h"])
    else:
        firsts = keyed.dropDuplicates(["h"])
    w = firsts.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/_checkpoint").outputMode("append")
    _run(w, trigger or {"availableNow": True})
    return f"{out}/data"


def visited_upsert_stream(spark: SparkSession, path: str, visited: DataFrame, out: str | None = None, trigger: dict | None = None) -> str:
    """ST3: insert-or-ignore of normalized keys into the visited table while pages arrive.

    The earlier runs' table is a static side (anti-join); keys repeated inside the stream
    are dropped by ``dropDuplicates`` state, which never expires (state store - RocksDB on a
    cluster); only new keys are appended through the exactly-once file sink. The visited table is the earlier
    table plus the sink. Nothing is rewritten per micro-batch.
    """
    out = out or scratch(spark, "visited")
    visited.select("url").write.mode("overwrite").parquet(f"{out}/table/run=0")
    earlier = spark.read.parquet(f"{out}/table/run=0")
    s = file_stream(spark, path)
    keys = s.select(U.normalize_url("url").alias("url")).join(earlier, "url", "left_anti").dropDuplicates(["url"])
    w = keys.writeStream.format("parquet").option("path", f"{out}/table/run=1").option("checkpointLocation", f"{out}/_checkpoint") \
        .outputMode("append")
    _run(w, trigger or {"availableNow": True})
    return f"{out}/table"


def read_visited(spark: SparkSession, table: str) -> DataFrame:
    """The visited table written by :func:`visited_upsert_stream`: earlier keys plus the
    sink's committed files (read through the sink path, so its commit log applies)."""
    return spark.read.parquet(f"{table}/run=0").unionByName(spark.read.parquet(f"{table}/run=1"))


CRAWLED = "url string, ts timestamp, status int, batch_no int"


def crawled_table(spark: SparkSession, folder: str, buckets: int = 64) -> VersionedTable:
    """D6's table: a row per URL, the latest (batch_no, ts) wins."""
    return VersionedTable(spark, folder, CRAWLED, ["url"], ["batch_no", "ts"], buckets)


def upsert_stream(spark: SparkSession, path: str, table: VersionedTable, checkpoint: str, trigger: dict | None = None, max_files: int | None = None) -> None:
    """ST3, insert-or-replace: results of fetches (the table's columns) that arrive are merged into ``table`` batch by batch.

    Each micro-batch rewrites the buckets it touches and commits under its id, so a batch that is replayed after a
    failure changes nothing. Late rows lose against newer ones that are in the table. A restarted query goes on from
    ``checkpoint``; the table is readable at every commit.
    """
    w = file_stream(spark, path, max_files).writeStream.foreachBatch(lambda rows, batch_id: _merged(table, rows, batch_id))
    _run(w.option("checkpointLocation", checkpoint), trigger or {"availableNow": True})


def _merged(table: VersionedTable, rows: DataFrame, batch_id: int) -> None:
    table.merge(rows, batch_id)


class LinkSink:
    """ST1 with links: what a batch of pages gives is written to ``text`` (page_id, text) and ``edges`` (H12), and the URLs that
    nobody saw before to ``frontier``. All three lie under the batch's id and count once the batch's commit to the
    table of seen URLs, its last step, is there: each row is delivered exactly once, however often a batch is tried."""

    OUTPUTS = {"text": "page_id bigint, text string", "edges": "page_id bigint, host string, src string, dst string, pos int", "frontier": "host string, url string"}

    def __init__(self, spark: SparkSession, out: str, buckets: int = 64):
        self.spark, self.out = spark, out.rstrip("/")
        self.seen = VersionedTable(spark, f"{self.out}/seen", "host string, url string", ["host", "url"], buckets=buckets)

    def start(self, seen: DataFrame) -> None:
        """The URLs that are seen before the stream; ignored where it has begun."""
        self.seen.merge(seen, -1)

    def _path(self, name: str, batch_id: int) -> str:
        return f"{self.out}/{name}/batch_id={batch_id}"

    def write(self, pages: DataFrame, batch_id: int) -> None:
        done = self.seen.batch()
        if done is not None and batch_id <= done:
            return
        # a batch may be one large file: its pages are dealt over all tasks, and read once for both outputs
        pages = pages.select("page_id", "url", "html").repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions"))).persist()
        try:
            pages.select("page_id", H.page_text("html").alias("text")).write.mode("overwrite").parquet(self._path("text", batch_id))
            L.link_edges(pages).write.mode("overwrite").parquet(self._path("edges", batch_id))
        finally:
            pages.unpersist()
        edges = self.spark.read.schema(self.OUTPUTS["edges"]).parquet(self._path("edges", batch_id))
        new = self.seen.lacking(edges.select("host", F.col("dst").alias("url")).distinct())
        new.write.mode("overwrite").parquet(self._path("frontier", batch_id))
        self.seen.merge(self.spark.read.schema(self.OUTPUTS["frontier"]).parquet(self._path("frontier", batch_id)), batch_id)

    def read(self, name: str) -> DataFrame:
        """An output's committed rows, with their batch_id."""
        done = self.seen.batch()
        rows = self.spark.read.schema(f"{self.OUTPUTS[name]}, batch_id bigint").option("basePath", f"{self.out}/{name}")
        paths = [self._path(name, k) for k in range((-1 if done is None else done) + 1)]
        return rows.parquet(*paths) if paths else self.spark.createDataFrame([], f"{self.OUTPUTS[name]}, batch_id bigint")


def link_stream(spark: SparkSession, path: str, sink: LinkSink, checkpoint: str, trigger: dict | None = None, max_files: int | None = None) -> None:
    """ST1: text, links and new URLs of pages while they arrive (see :class:`LinkSink`). The seen URLs are state in a
    versioned table, so the frontier feeds a crawl at any commit and the state is no larger than the URLs."""
    w = file_stream(spark, path, max_files).writeStream.foreachBatch(lambda pages, batch_id: sink.write(pages, batch_id))
    _run(w.option("checkpointLocation", checkpoint), trigger or {"availableNow": True})


def event_counters(spark: SparkSession, path: str, out: str | None = None, trigger: dict | None = None,
                   window: str = "1 day", lateness: str = "1 hour", max_files: int | None = None) -> str:
    """ST4: crawl counters per event-time tumbling window and type. Update mode: a row later
    than the watermark (max event time - ``lateness``) is dropped and finished windows'
    state is evicted. Each micro-batch writes its updated windows under its batch id
    (idempotent on replay); the table is the latest update per window, compacted at the end."""
    out = out or scratch(spark, "counters")
    s = file_stream(spark, path, max_files).withColumn("et", ntz_to_instant("ts"))
    agg = s.withWatermark("et", lateness).groupBy(F.window("et", window).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("value_sum")
    )

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.unix_seconds(F.col("w.start")).alias("window_start"), "event_type", "n", "errors", "value_sum") \
            .write.mode("overwrite").parquet(f"{out}/updates/batch_id={batch_id}")

    w = agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{out}/_checkpoint")
    _run(w, trigger or {"availableNow": True})
    ups = spark.read.parquet(f"{out}/updates")
    latest = ups.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "errors", "value_sum"), "batch_id").alias("r"))
    latest.select("window_start", "event_type", "r.n", "r.errors", "r.value_sum").write.mode("overwrite").parquet(f"{out}/data")
    return f"{out}/data"
