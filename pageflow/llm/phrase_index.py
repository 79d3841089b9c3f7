"""Benchmark decontamination with a distributed positional inverted index (operator 8).

The index is split by documents: a row of the index table is a block of some documents with its own
postings, that is each term with the sorted places where it stands in the block. Building it needs no
shuffle, blocks are bounded in size, and the table is written once to the shared folder, so that any
number of benchmarks can be looked up in it and a lost executor repeats single blocks. A row takes megabytes, so
Python tasks get rows in small batches, and Parquet's row groups and pages hold few.

A lookup takes phrases (windows of benchmark words, cut in tasks and dealt by hash over parts of bounded
size in the shared folder). Tasks read one part at a time and look it up in each block: of a phrase's terms
the one with the shortest postings in the block gives the candidates, and the lists of the others, from rare
to common, are intersected with them. Offset by the terms' places in the phrase they give exact matches; within
a stretch of ``span`` words, in any order and with other words between, proximity matches. Hits of a part are
written before the next is read, and merged per document; the driver sees the number of parts alone.

Null texts have no words. Repeated rows and null ids are documents of their own. Benchmark rows
without id, or without words, match nothing; repeated ones count once. Only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm.common import LARGE_ROWS, shared_path, small_batches, table, utf8, written
from pageflow.llm.warc import _opens

#: Words of an index block, bytes of benchmark text that are looked up at once (their windows take about
#: ``window`` times that), candidates that are tested at once, and phrases that are.
BLOCK_WORDS, PART_BYTES, TESTED, PHRASES = 1 << 20, 1 << 22, 1 << 18, 1 << 16
#: Bytes of a text whose words are held at once, and items of hits that are returned at once.
SLICE, RETURNED = 1 << 22, 1 << 18
#: Words of a stretch that a proximity match fits in.
SPAN = 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

INDEX = "block string, doc_ids array<bigint>, starts array<bigint>, terms array<binary>, offsets array<bigint>, places binary"


def alnum_words(raw: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return raw.translate(_TABLE).split()


def alnum_slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of ``alnum_words``, some megabytes at a time."""
    at, raw = 0, raw.translate(_TABLE)
    while at < len(raw):
        end = raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _block(name: str, ids: list, sizes: list[int], terms: dict[bytes, int], parts: list[np.ndarray]) -> pa.RecordBatch:
    stream = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    places = np.argsort(stream, kind="stable").astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(stream, minlength=len(terms)))])
    starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())
    row = (name, ids, starts, list(terms), offsets, places.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["block", "doc_ids", "starts", "terms", "offsets", "places"])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The index of all whole texts, written to the shared folder."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0

        def fresh():
            return [], [], defaultdict(count().__next__), []

        ids, sizes, terms, parts = fresh()
        held = 0
        for batch in batches:
            for key_, raw in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(key_.as_py())
                sizes.append(0)
                for words in alnum_slices(raw.as_buffer().to_pybytes()) if raw.is_valid else ():
                    parts.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
                    sizes[-1] += len(words)
                held += sizes[-1] + 1
                if held >= block_words:
                    yield _block(f"{TaskContext.get().partitionId()}-{number}", ids, sizes, terms, parts)
                    number += 1
                    (ids, sizes, terms, parts), held = fresh(), 0
        if ids:
            yield _block(f"{TaskContext.get().partitionId()}-{number}", ids, sizes, terms, parts)

    texts = docs.select(F.col(key).alias("doc_id"), utf8(text).alias("text"))
    with small_batches(docs.sparkSession):
        return written(texts.mapInArrow(blocks, INDEX), "postings", **LARGE_ROWS)


class Phrases:
    """A part of the benchmark's windows: their terms by width, and the items that hold them."""

    def __init__(self, windows: pa.Table):
        distinct = windows["window"].combine_chunks().dictionary_encode()
        number = distinct.indices.to_numpy()
        self.owners = windows["item_id"].to_numpy()[np.argsort(number, kind="stable")]
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(distinct.dictionary)))])
        vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        by_width: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for low in range(0, len(distinct.dictionary), PHRASES):
            words = pc.split_pattern(distinct.dictionary.slice(low, PHRASES), b" ")
            width, flat = pc.list_value_length(words).to_numpy(), words.flatten().dictionary_encode()
            term = np.array([vocabulary[w] for w in flat.dictionary.to_pylist()], np.int32)[flat.indices.to_numpy()]
            first = np.cumsum(width) - width
            for w in np.unique(width):
                of = np.flatnonzero(width == w)
                by_width[int(w)].append((term[first[of][:, None] + np.arange(w)], low + of))
        self.terms = pa.array(list(vocabulary), pa.binary())
        self.widths = [tuple(map(np.concatenate, zip(*parts, strict=True))) for parts in by_width.values()]

    def items(self, phrases: np.ndarray) -> np.ndarray:
        """The distinct items that hold any of some phrases, sorted."""
        return np.unique(np.concatenate([self.owners[self.offsets[p] : self.offsets[p + 1]] for p in phrases]))


class Postings:
    """One block of the index, as far as a vocabulary needs it.

    ``key`` holds the postings of all its terms as (term, place) in one sorted array, so that the lists of many
    terms can be searched at once.
    """

    def __init__(self, row: pa.RecordBatch, vocabulary: pa.Array):
        of = {name: row.column(name)[0] for name in row.schema.names}
        self.block, self.ids = of["block"].as_py(), of["doc_ids"].values
        self.starts = of["starts"].values.to_numpy()
        places = np.frombuffer(of["places"].as_buffer(), np.int32)
        offsets = of["offsets"].values.to_numpy()
        self.n = len(places)
        number = pc.index_in(of["terms"].values, value_set=vocabulary).fill_null(-1).to_numpy()
        wanted = np.flatnonzero(number >= 0)
        self.known = np.full(len(vocabulary), -1, np.int64)  # a term's number in this block
        self.known[number[wanted]] = np.arange(len(wanted))
        self.size = offsets[wanted + 1] - offsets[wanted]
        self.first = np.cumsum(self.size) - self.size
        self.key = places[np.repeat(offsets[wanted] - self.first, self.size) + np.arange(self.size.sum())].astype(np.int64)
        self.key += np.repeat(np.arange(len(wanted)) * (self.n + 1), self.size)

    def of(self, term: int) -> np.ndarray:
        return self.key[self.first[term] : self.first[term] + self.size[term]] - term * (self.n + 1)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1

    def stands(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a posting from ``low`` to ``high``."""
        base = term * (self.n + 1)
        at = np.searchsorted(self.key, base + low)
        return (at < len(self.key)) & (self.key[np.minimum(at, len(self.key) - 1)] <= base + high)

    def candidates(self, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, place) of all postings of each row's term, at most ``TESTED`` at a time."""
        ends = np.cumsum(self.size[term])
        for low in range(0, int(ends[-1]) if len(ends) else 0, TESTED):
            flat = np.arange(low, min(low + TESTED, ends[-1]))
            row = np.searchsorted(ends, flat, "right")
            t = term[row]
            yield row, self.key[self.first[t] + flat - (ends[row] - self.size[t])] - t * (self.n + 1)

    def matches(self, words: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(phrase, place of its rarest term, start or -1) of proximity matches, some at a time; a start is an exact match's."""
        for low in range(0, len(words), PHRASES):
            for row, place, start in self._matches(words[low : low + PHRASES], max(span, words.shape[1])):
                yield low + row, place, start

    def _matches(self, words: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        terms = self.known[words]
        alive = np.flatnonzero((terms >= 0).all(axis=1))
        terms, width = terms[alive], words.shape[1]
        rare = np.argsort(self.size[terms], axis=1, kind="stable") if len(alive) else np.zeros((0, width), np.int64)
        for row, place in self.candidates(terms[np.arange(len(alive)), rare[:, 0]]):
            doc = self.document(place)
            first, last = self.starts[doc], self.starts[doc + 1] - 1
            for k in range(1, width):
                ok = self.stands(terms[row, rare[row, k]], np.maximum(place - span + 1, first), np.minimum(place + span - 1, last))
                row, place, first, last = row[ok], place[ok], first[ok], last[ok]
            start = place - rare[row, 0]
            exact = (start >= first) & (start + width - 1 <= last)
            for k in range(width):
                exact[exact] = self.stands(terms[row[exact], k], start[exact] + k, start[exact] + k)
            near = exact.copy()
            for back in range(span):  # the stretches that hold the rarest term
                open_ = np.flatnonzero(~near)
                low = place[open_] - back
                for k in range(1, width):
                    ok = self.stands(terms[row[open_], rare[row[open_], k]], np.maximum(low, first[open_]), np.minimum(low + span - 1, last[open_]))
                    open_, low = open_[ok], low[ok]
                near[open_] = True
            yield alive[row[near]], place[near], np.where(exact, start, -1)[near]

    def near(self, terms: list[int], within: int) -> np.ndarray:
        """Places of the rarest term with every other term at most ``within`` words away in its document."""
        rarest, *rest = sorted(set(terms), key=lambda t: self.size[t])
        place = self.of(rarest)
        doc = self.document(place)
        low, high = np.maximum(place - within, self.starts[doc]), np.minimum(place + within, self.starts[doc + 1] - 1)
        for t in rest:
            ok = self.stands(np.int64(t), low, high)
            place, low, high = place[ok], low[ok], high[ok]
        return place


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1)


WINDOWS = "window binary, item_id bigint"
HITS = "block string, doc bigint, runs array<struct<s: bigint, e: bigint>>, items array<bigint>, near array<bigint>"


def benchmark_windows(items: DataFrame, window: int, part_bytes: int = PART_BYTES) -> tuple[str, int]:
    """Writes the distinct (window, item_id) of (item_id, text) rows to the shared folder; its path and number of parts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0), batch.column(1), strict=True):
                words = alnum_words(raw.as_buffer().to_pybytes())
                number = max(1, len(words) - window + 1) if words else 0
                for low in range(0, number, 1 << 16):
                    some = [b" ".join(words[k : k + window]) for k in range(low, min(number, low + (1 << 16)))]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([item.as_py()] * len(some), pa.int64())], names=["window", "item_id"])

    given = items.filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = given.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = -(-size // part_bytes)
    path = shared_path(items.sparkSession, "windows")
    if parts:
        pairs = given.select("item_id", utf8("text").alias("text")).mapInArrow(cut, WINDOWS).distinct()
        dealt = pairs.withColumn("part", F.pmod(F.xxhash64("window", "item_id"), F.lit(parts)))
        dealt.repartition("part").write.partitionBy("part").parquet(path)
    return path, parts


def _reader(spark: SparkSession, path: str, part: int) -> Callable[[], pa.Table]:
    """How a task gets a part's windows: from the shared folder, or, where only Spark's readers can open it, sent along."""
    kinds = pa.schema([("window", pa.binary()), ("item_id", pa.int64())])
    if not _opens(path):
        rows = spark.read.schema(f"{WINDOWS}, part int").parquet(path).filter(F.col("part") == part).select("window", "item_id").collect()
        sent = pa.Table.from_pylist([{"window": bytes(r.window), "item_id": r.item_id} for r in rows], kinds)
        return lambda: sent

    def read() -> pa.Table:
        system, inner = pafs.FileSystem.from_uri(f"{path}/part={part}")
        if system.get_file_info(inner).type == pafs.FileType.NotFound:  # no window was dealt to this part
            return kinds.empty_table()
        files = [f.path for f in system.get_file_info(pafs.FileSelector(inner)) if f.path.endswith(".parquet")]
        return pa.concat_tables([pq.ParquetFile(system.open_input_file(f)).read(columns=["window", "item_id"]).cast(kinds) for f in files])

    return read


def _hits(block: Postings, phrases: Phrases, hit: np.ndarray, found: np.ndarray, close: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a block's hits; ``hit``: the words that are, ``found`` and ``close``: sorted pairs of exact and proximity matches."""
    kinds = len(phrases.offsets)
    bounds = lambda pairs, doc: np.searchsorted(pairs, [doc * kinds, (doc + 1) * kinds])
    schema = pa.schema([("block", pa.string()), ("doc", pa.int64()), ("runs", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.int64())), ("near", pa.list_(pa.int64()))])
    rows, held = [], 0
    for doc in np.unique(close // kinds):
        a, b = block.starts[doc], block.starts[doc + 1]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a + 1 : b + 1], [False]]).astype(np.int8)))
        (low, high), (from_, to) = bounds(close, doc), bounds(found, doc)
        near = phrases.items(close[low:high] % kinds)
        items = phrases.items(found[from_:to] % kinds) if to > from_ else near[:0]
        rows.append((block.block, int(doc), [{"s": int(s), "e": int(e)} for s, e in edge.reshape(-1, 2)], items, near))
        held += len(items) + len(near) + len(edge)
        if held >= RETURNED:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _part_hits(index: DataFrame, read: Callable[[], pa.Table], span: int) -> DataFrame:
    """Hits of a part's windows: per document the hit runs of words, the items and those near it."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = None
        for row in _rows(batches):
            phrases = phrases or Phrases(read())
            block, kinds = Postings(row, phrases.terms), len(phrases.offsets)
            mark = np.zeros(block.n + 1, np.int64)
            found, close = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # (document, phrase) as one number
            for words, number in phrases.widths:
                for which, place, start in block.matches(words, span):
                    pair, exact = block.document(place) * kinds + number[which], start >= 0
                    np.add.at(mark, start[exact], 1)
                    np.add.at(mark, start[exact] + words.shape[1], -1)
                    found.append(np.unique(pair[exact]))
                    close.append(np.unique(pair))
            hit = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
            yield from _hits(block, phrases, hit, np.unique(np.concatenate(found)), np.unique(np.concatenate(close)))

    return index.mapInArrow(look_up, HITS)


def benchmark_hits(index: DataFrame, items: DataFrame, window: int, span: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """(block, doc, runs, items, near) of every part of the benchmark, written part by part."""
    spark = index.sparkSession
    windows, parts = benchmark_windows(items, window, part_bytes)
    if not parts:
        return spark.createDataFrame([], HITS)
    path = shared_path(spark, "hits")
    with small_batches(spark):
        for part in range(parts):
            _part_hits(index, _reader(spark, windows, part), span).write.parquet(f"{path}/part={part}")
    return spark.read.schema(f"{HITS}, part int").parquet(path).drop("part")


def proximity_matches(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """(doc_id, place): words of the rarest term that have all other terms at most ``within`` words away."""
    wanted = [w for t in terms for w in alnum_words(t.encode())]
    vocabulary = pa.array(sorted(set(wanted)), pa.binary())

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Postings(row, vocabulary)
            place = block.near(block.known.tolist(), within) if len(vocabulary) and (block.known >= 0).all() else np.zeros(0, np.int64)
            doc = block.document(place)
            yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(doc)), pa.array(place - block.starts[doc], pa.int64())], names=["doc_id", "place"])

    return index.mapInArrow(look_up, "doc_id bigint, place bigint")


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES, span: int = SPAN
) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of each row of ``docs``.

    A word is hit if an occurrence of a benchmark window of ``window`` words covers it; a document
    is contaminated if a twentieth of its words are hit. ``n_near`` counts the items of which all words of a window,
    in any order, stand in a stretch of ``span`` words (at least the window's); exact matches are among them.
    """
    index = build_index(docs, key, text)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    hits = benchmark_hits(index, items, window, span, part_bytes)
    sized = F.transform(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda k: F.struct(
        k.cast("bigint").alias("d"), F.get("doc_ids", k).alias("doc_id"), (F.get("starts", k + 1) - F.get("starts", k)).alias("n")))
    rows = index.select("block", F.explode(sized).alias("r")).select("block", "r.*")
    merged = hits.groupBy(F.col("block").alias("b"), "doc").agg(
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")))
    rows = rows.join(merged, (F.col("block") == F.col("b")) & (F.col("d") == F.col("doc")), "left")
    n_hit = F.expr(
        "aggregate(coalesce(runs, array()), named_struct('n', 0L, 'at', 0L), (a, r) -> named_struct('n', "
        "a.n + greatest(0L, r.e - greatest(a.at, r.s)), 'at', greatest(a.at, r.e)), a -> a.n)"
    )
    names = F.array_sort(F.transform(F.coalesce("items", F.expr("CAST(array() AS array<bigint>)")), lambda i: i.cast("string")))
    out = rows.select("doc_id", F.col("n").alias("n_words"), n_hit.alias("n_hit"), names.alias("names"), F.coalesce(F.size("near"), F.lit(0)).alias("near"))
    return out.select(
        F.col("doc_id").alias(key), "n_words", "n_hit", F.size("names").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "names"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.greatest("near", F.lit(0)).cast("bigint").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns. Rows that share a key share its fate."""
    bad = contamination(docs, benchmark, key=key, text=text).filter("contaminated").select(F.col(key).alias("_bad")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["_bad"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
x AS (SELECT item_id, least(13, len(w)) AS k, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM x),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
k AS (SELECT DISTINCT k FROM g),
e AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k),
h AS (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM e),
m AS (SELECT h.doc_id, h.p, h.k, g.item_id FROM h JOIN g USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY 1),
y AS (SELECT k, g, list_distinct(string_split(g, ' ')) AS ts FROM (SELECT DISTINCT k, g FROM g)),
o AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM d),
v AS (SELECT term, count(*) AS n FROM o GROUP BY 1),
l AS (SELECT k, g, arg_min(term, n) AS term FROM (SELECT k, g, unnest(ts) AS term FROM y) JOIN v USING (term) GROUP BY 1, 2),
a AS (SELECT o.doc_id, y.k, y.g, y.ts, d.w, o.p FROM o JOIN l USING (term) JOIN y ON y.k = l.k AND y.g = l.g JOIN d ON d.doc_id = o.doc_id
  WHERE list_has_all(d.w[greatest(1, o.p - 19) : o.p + 19], y.ts)),
b AS (SELECT doc_id, k, g, ts, w, unnest(range(greatest(1, p - 19), p + 1)) AS s FROM a),
r AS (SELECT b.doc_id, count(DISTINCT g.item_id) AS n FROM b JOIN g ON b.k = g.k AND b.g = g.g WHERE list_has_all(b.w[b.s : b.s + 19], b.ts) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated,
  coalesce(r.n, 0) AS n_near
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN r USING (doc_id)
"""
