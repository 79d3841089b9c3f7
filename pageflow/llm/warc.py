"""Web archives with a two-level capture index (operator 5).

``write_archives`` writes pages as WARC records with Spark's text writer: a record's end is the line
separator, so each part file is an archive, on whatever file system the shared folder has. Of
pages with equal payloads the one of least id is a response and the others are revisits without payload.

``build_index`` scans the archives once. Its entries are sorted by reversed host, path and page id over
range partitions (a hot host or URL is split, because the id is part of the key) and packed into compressed
blocks of ``BLOCK`` entries. The directory holds the first key of every block, in one list per
partition; above it stand the first keys of the partitions, as many rows as there are partitions.

``look_up`` sends each wanted key to its partition by binary search in the top level, finds the block by binary
search in that partition's directory and the entry by binary search in the block. ``read_records``
takes the found byte ranges out of the archives.

Null html is an empty payload, null urls have an empty key, null ids are ids of their own. Rows that
repeat are records of their own. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm.common import checkpointed, partitions, shared_path, table, written

#: Entries of an index block, records of an archive file, bytes of the least payload that is revisited.
BLOCK, FILE_RECORDS, LEAST = 512, 1000, 100
#: Bytes of an archive file at most, unless a single record is larger; readers hold a file in memory.
FILE_BYTES = 256 << 20
#: Repeated payloads (80 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
LINE, GAP = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_kinds(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, bytes, digest, refers_to); refers_to is null for responses."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("bytes", F.octet_length("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = checkpointed(groups.filter("n > 1").select(F.col("digest").alias("d"), "first"))
    if groups.count() <= BROADCAST_ROWS:  # then payloads need no shuffle
        groups = F.broadcast(groups)
    joined = rows.join(groups, F.col("digest") == F.col("d"), "left")
    later = F.coalesce(~F.col("first").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "payload", "bytes", "digest", F.when(later, F.col("first")).alias("refers_to"))


def _urn(page_id, digest) -> F.Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def clean_url(url) -> F.Column:
    """A URL that fits in a header line."""
    return F.replace(F.replace(F.trim(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", file_records: int = FILE_RECORDS) -> str:
    """Writes a WARC record per page below ``path``, in files of at most ``file_records`` records and about ``FILE_BYTES``.

    Pages are written by size class, each eight times the one before it with an eighth of the records in a file. Nearly
    all are of the first one; a class without pages isn't written.
    """
    rows = record_kinds(pages)
    size, least = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)), FILE_BYTES // file_records
    steps = [least * 8**k for k in range(len(str(FILE_BYTES)))]
    size_class = lambda n: sum((F.when(n > step, 1).otherwise(0) for step in steps), F.lit(0))
    classes = sorted(r[0] for r in pages.select(size_class(size)).distinct().collect()) or [0]  # some ten numbers at most
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(GAP))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))

    def line(name: str, value) -> F.Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))

    head = F.concat(
        F.lit(f"WARC/1.1{LINE}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", clean_url(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), line("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to"), F.col("digest")))),
        line("WARC-Page-ID", F.col("page_id").cast("string")), line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")),
    )
    own = size_class(F.col("bytes") + F.coalesce(F.octet_length("url"), F.lit(0)))
    for k in classes:
        some = rows if classes == [k] else rows.filter(own == k)
        lines = some.select(F.concat(head, F.lit(LINE), block).alias("value"))
        lines.write.mode("append").option("lineSep", GAP).option("maxRecordsPerFile", max(1, file_records // 8**k)).text(path)
    return path


def surt(url: str | None) -> str:
    """Sort key of a URL: the host's labels from right to left, then port, path and query."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    rest = parts.path or "/"
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest + (f"?{parts.query}" if parts.query else "")


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(LINE)
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, header fields) of each record of an archive, by its Content-Length."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        fields = parse_head(content[at:end])
        length = end - at + 4 + int(fields["content-length"])
        yield at, length, fields
        at += length + 4


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


ENTRIES = "key string, page_id bigint, path string, at bigint, length bigint"
BLOCKS = "part int, number int, key string, page_id bigint, entries binary"


def build_index(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(part, number, key, page_id, entries): compressed blocks in key order, with their first keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(surt(f.get("warc-target-uri")), int(f["warc-page-id"]) if "warc-page-id" in f else None, name, a, n) for a, n, f in records(content.as_buffer().to_pybytes())]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ENTRIES.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        part, number = TaskContext.get().partitionId(), 0

        def made(rows: list[list]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary())
            row = (part, number, rows[0][0], rows[0][1], zlib.compress(json.dumps(rows).encode()))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            held += map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True))
            while len(held) >= block:
                yield made(held[:block])
                held, number = held[block:], number + 1
        if held:
            yield made(held)

    entries = checkpointed(_archives(spark, path).mapInArrow(scan, ENTRIES))
    order = ("key", "page_id", "path", "at")
    return written(entries.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(pack, BLOCKS), "captures")


def _rank(key: str | None, page_id: int | None) -> tuple:
    """Order of the index: by key, then id, ids that are null first."""
    return key or "", page_id is not None, page_id or 0


FOUND = "key string, page_id bigint, path string, at bigint, length bigint"


def look_up(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The entries of the wanted (url, page_id) captures."""
    first = index.groupBy("part").agg(F.min(F.struct("number", "key", "page_id")).alias("f")).select("part", "f.*").collect()
    top = sorted((_rank(r.key, r.page_id), r.part) for r in first)  # one entry per partition of the index
    bounds, parts = [x[0] for x in top], [x[1] for x in top]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [surt(u) for u in batch.column(0).to_pylist()], batch.column(1)
            # equal captures may go on from an earlier partition's end
            spans = [(bisect_left(bounds, x), bisect_right(bounds, x)) for x in map(_rank, keys, ids.to_pylist())]
            rows = [(k, parts[p]) for k, (a, b) in enumerate(spans) for p in range(max(0, a - 1), b)]
            at = pa.array([k for k, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([p for _, p in rows], pa.int32()), pa.array(keys, pa.string()).take(at), ids.take(at)], names=["part", "key", "page_id"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory: dict[int, tuple[list, list]] = {}
        opened: tuple = (None, None)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            out: list[list] = []
            for part, number, key, page_id, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = directory.setdefault(part, ([], []))
                rank = _rank(key, page_id)
                if number is not None:
                    mine[0].append(rank)
                    mine[1].append(entries)
                    continue
                n = max(0, bisect_left(mine[0], rank) - 1)
                while n < len(mine[0]) and mine[0][n] <= rank:
                    if opened[0] != (part, n):
                        rows = json.loads(zlib.decompress(mine[1][n]))
                        opened = (part, n), ([_rank(r[0], r[1]) for r in rows], rows)
                    ranks, rows = opened[1]
                    out += rows[bisect_left(ranks, rank) : bisect_right(ranks, rank)]
                    n += 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    keys = wanted.select(clean_url(F.col("url")).alias("url"), "page_id").distinct().mapInArrow(send, "part int, key string, page_id bigint").distinct()
    asked = keys.select("part", F.lit(None).cast("int").alias("number"), "key", "page_id", F.lit(None).cast("binary").alias("entries"))
    # a partition's blocks come first, then its keys in order
    both = index.unionByName(asked).withColumn("later", F.col("number").isNull())
    both = both.repartition("part").sortWithinPartitions("part", "later", "number", "key", "page_id").drop("later")
    return both.mapInArrow(search, FOUND)


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, same boolean"


def _record(page_id: int | None, raw: bytes) -> tuple:
    """A row of READ from the bytes of one record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = parse_head(head)
    said = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "revisit":
        return page_id, None, said, "revisit", int(fields["warc-refers-to-page-id"]), None
    payload = block.partition(b"\r\n\r\n")[2]
    own = hashlib.sha256(payload).hexdigest()
    return page_id, len(payload), own, "response", None, own == said


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


def _opens(path: str) -> bool:
    """Whether Arrow's file systems can read the folder (local and mounted ones, S3, GCS, Azure, HDFS with libhdfs)."""
    try:
        system, inner = pafs.FileSystem.from_uri(path)
        return system.get_file_info(inner).type == pafs.FileType.Directory
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False


def read_records(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """The records at the found byte ranges: type, size and digest of the payload as it stands there.

    Tasks read the ranges alone, sorted by file and offset. Where only Spark's readers can open
    the folder, files and their ranges (at most ``FILE_RECORDS`` a file) are joined instead.
    """
    if _opens(path):

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name = file = None
            for batch in batches:
                rows = []
                for page_id, uri, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if uri != name:
                        system, inner = pafs.FileSystem.from_uri(uri)
                        name, file = uri, system.open_input_file(inner)
                    rows.append(_record(page_id, file.read_at(length, at)))
                yield _read_batch(rows)

        ranges = found.repartition(F.col("path")).sortWithinPartitions("path", "at")
        return ranges.select("page_id", "path", "at", "length").mapInArrow(fetch, READ)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, ranges in zip(batch.column(0), batch.column(1), strict=True):
                whole = content.as_buffer()
                yield _read_batch([_record(r["page_id"], whole.slice(r["at"], r["length"]).to_pybytes()) for r in ranges.as_py()])

    ranges = found.groupBy(F.col("path").alias("p")).agg(F.collect_list(F.struct("page_id", "at", "length")).alias("ranges"))
    return _archives(spark, path).join(ranges, F.col("path") == F.col("p")).select("content", "ranges").mapInArrow(cut, READ)


def captures(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives, indexes them and reads every page back through the index."""
    path = write_archives(pages, shared_path(spark, "warc"))
    index = build_index(spark, path)
    got = checkpointed(read_records(spark, path, look_up(index, pages.select("url", "page_id"))))
    full = got.filter("record_type = 'response'").groupBy(F.col("page_id").alias("r"), F.col("payload_digest").alias("d")).agg(F.first("payload_bytes").alias("n"))
    later = got.filter("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("r")) & (F.col("payload_digest") == F.col("d")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return got.filter("record_type = 'response'").select(*columns).unionByName(later.withColumn("payload_bytes", F.col("n")).select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
