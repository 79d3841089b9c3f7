"""Repeated passages by sparse suffix arrays (operator 10).

Only suffixes that start at content-selected places are kept: of each run of ``WINDOW`` places, the one whose
k-word hash is least (a minimiser). Each run of ``LEAST`` = 51 words belongs to the minimiser of its first
places, whose next LEAST - WINDOW + 1 words (the seed) lie inside it. Equal runs select equal places, so
documents that share one share a kept suffix of equal seed. The runs of one suffix start at consecutive
words; together they are its block (at most LEAST + WINDOW - 1 words).

1. Kept suffixes are narrow rows (document, place, seed, ends and hash of the block), written once. Documents of equal words
   form a class: all of them repeat from end to end, and only the first goes on. Seeds of one class go.
2. The documents supply each suffix that is left with the words behind its seed and before it (32-bit hashes), as far as
   the ends of a match of LEAST words can be. The suffixes are sorted over range partitions by seed, words behind and
   words before; a hot passage is split, as the order goes on with document and place. Each is compared with its nearest
   neighbours of other documents on both sides, and the match is extended left and right. LEAST words make a span.
3. A neighbour hides matches where a third document lies between, and rows at the ends of partitions miss one neighbour. So the
   comparison is made complete by hash: blocks that stand in two documents are spans, and
   for seeds that have several blocks, of which one isn't a span yet, the documents supply the hash of each run of LEAST
   words (at most WINDOW for a block; of equal blocks in two documents only one is asked). Runs that stand in two
   documents are spans.
4. The spans of a document are merged where they overlap.

The comparisons by hash are the least and greatest document of each hash, so hot passages are combined before the shuffle.
Their hashes have 64 bits.

A-Z count as lower case; words are runs without ASCII white space. Null, empty and short texts repeat
nothing, and passages that repeat inside one document alone don't count. ``doc_id`` names documents: repeated
rows of one id don't match each other, and rows without id are left out. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageflow.llm.common import checkpointed, partitions, table, utf8, written
from pageflow.llm.minhash import distinct_rows
from pageflow.llm.words import gram_hashes, mix, word_hashes

#: Words of the least match; words of the minimisers' grams; places of which one is kept.
LEAST, K, WINDOW = 51, 5, 30
#: Rows of a batch that a task gives back.
ROWS = 50_000
ODD = np.uint64(0xD6E8FEB86659FD93)


def _selected(words: np.ndarray, k: int, window: int) -> np.ndarray:
    """For each run of ``window`` places, the place of the least k-word hash, the first of equals."""
    if len(words) < k + window - 1:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(gram_hashes(words, k), window)
    return runs.argmin(axis=1) + np.arange(len(runs))


def minimisers(words: np.ndarray, k: int, window: int) -> np.ndarray:
    """Places of the least k-word hash in each run of ``window`` places, the first of equals."""
    return np.unique(_selected(words, k, window))


def run_hashes(words: np.ndarray, least: int) -> np.ndarray:
    """A 64-bit hash of each run of ``least`` words, by doubling: two overlapping runs give the longer one."""
    size, out = 1, words
    with np.errstate(over="ignore"):
        while size < least:
            step = min(size, least - size)
            out = mix(out[:-step] * ODD + out[step:])
            size += step
    return out


def blocks(words: np.ndarray, runs: np.ndarray, least: int, k: int, window: int) -> tuple[np.ndarray, ...]:
    """(place, start, stop, seed, hash) of each kept suffix and its block; ``runs`` are the hashes of the runs of ``least`` words."""
    if len(words) < least:
        return (*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 2)
    places = _selected(words, k, window)[: len(runs)]
    first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    last = np.append(first[1:], len(runs)) - 1
    with np.errstate(over="ignore"):
        both = mix((runs[first] * ODD + runs[last]) * ODD + (last - first).astype(np.uint64))
    return places[first], first, last + least, gram_hashes(words, least - window + 1)[places[first]], both


def _words(raw: pa.Scalar) -> np.ndarray:
    return word_hashes(raw.as_buffer().to_pybytes().lower()) if raw.is_valid else np.zeros(0, np.uint64)


def _text_key(words: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63)


def _batches(parts: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples of arrays."""
    columns = [pa.chunked_array([x if isinstance(x, pa.Array) else pa.array(x) for x in c]) for c in zip(*parts, strict=True)]
    if columns:
        yield from pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches(max_chunksize=ROWS)


SUFFIXES = "doc_id bigint, text_key bigint, place bigint, start bigint, stop bigint, seed bigint, block bigint"


def _suffixes(docs: DataFrame, least: int, k: int, window: int) -> DataFrame:
    """The kept suffixes of every document, and a row with null seed whose stop is its number of words."""
    names = [x.split()[0] for x in SUFFIXES.split(", ")]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(raw)
                text_key, none = _text_key(words), pa.nulls(1, pa.int64())
                place, start, stop, seed, block = blocks(words, run_hashes(words, least), least, k, window)
                parts.append((np.full(len(start), key), np.full(len(start), text_key), place, start, stop, seed.view(np.int64), block.view(np.int64)))
                parts.append((*[np.full(1, x) for x in (key, text_key, 0, 0, len(words))], none, none))
                size += len(start) + 1
                if size >= ROWS:
                    yield from _batches(parts, names)
                    parts, size = [], 0
            yield from _batches(parts, names)

    return docs.mapInArrow(keep, SUFFIXES)


#: ``key`` is a seed for suffixes (with words around it) and the hash of a run for runs.
FETCHED = "is_run boolean, key bigint, lo bigint, hi bigint, start bigint, n_behind int, n_before int, behind binary, before binary"


def _around(small: np.ndarray, places: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Counts and hashes of the ``reach`` words behind each seed and of those before it, nearest first."""
    edge = np.zeros(reach, small.dtype)
    padded = np.concatenate([edge, small, edge])
    step = np.arange(reach)
    behind = padded[places[:, None] + reach + length + step]
    before = padded[places[:, None] + reach - 1 - step]
    counts = (np.clip(x, 0, reach).astype(np.int32) for x in (len(small) - places - length, places))
    return (*counts, *(pa.array([row.tobytes() for row in x], pa.binary()) for x in (behind, before)))


def _fetched(texts: DataFrame, suffixes: DataFrame, asked: DataFrame, least: int, window: int) -> DataFrame:
    """The words around ``suffixes``, and the runs of the blocks ``asked`` with the least and greatest document that has the block."""
    names = [x.split()[0] for x in FETCHED.split(", ")]
    length = least - window + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for raw, wanted in zip(batch.column(0), batch.column(1), strict=True):
                words = _words(raw)
                text_key, runs = _text_key(words), run_hashes(words, least).view(np.int64)
                of = wanted.values
                columns = ("is_run", "text_key", "seed", "place", "start", "stop", "lo", "hi")
                is_run, keys, *rest = (of.field(x).to_numpy(zero_copy_only=False) for x in columns)
                own = keys == text_key
                seed, place, _, _, lo, hi = (x[own & ~is_run] for x in rest)
                if len(seed):
                    parts.append((np.zeros(len(seed), bool), seed, lo, hi, place, *_around((words >> np.uint64(32)).astype("<u4"), place, length, least - length)))
                _, _, start, stop, lo, hi = (x[own & is_run] for x in rest)
                count = stop - least + 1 - start
                total = int(count.sum())
                at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)
                none = [pa.nulls(total, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())]
                parts.append((np.ones(total, bool), runs[at], np.repeat(lo, count), np.repeat(hi, count), at, *none))
                size += total + 4 * len(seed)
                if size >= ROWS:
                    yield from _batches(parts, names)
                    parts, size = [], 0
            yield from _batches(parts, names)

    columns = ("text_key", "seed", "place", "start", "stop", "lo", "hi")
    both = suffixes.select("doc_id", F.lit(False).alias("is_run"), *columns).unionAll(asked.select("doc_id", F.lit(True).alias("is_run"), *columns))
    wanted = both.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("is_run", *columns)).alias("wanted"))
    return texts.join(wanted, F.col("doc_id") == F.col("d")).select("text", "wanted").mapInArrow(add, FETCHED)


SPANS = "doc_id bigint, start bigint, stop bigint, other bigint"


def _shared(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that rows of two matrices have in common from their start, ``most`` at most."""
    same = a == b
    return np.minimum(np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)), most)


def _scan(batches: Iterator[pa.RecordBatch], least: int, window: int) -> Iterator[pa.RecordBatch]:
    """Spans of sorted suffixes: each row against the nearest rows of other documents before and after it."""
    length, names = least - window + 1, [x.split()[0] for x in SPANS.split(", ")]
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        words = [np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(batch.num_rows, -1) for k in (5, 6)]
        rows = numbers + words
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        seed, doc, place, n_behind, n_before, behind, before = rows
        n = len(seed)
        cut = np.flatnonzero(doc[1:] != doc[:-1]) + 1
        first, last = np.append(0, cut), np.append(cut, n)
        size = last - first
        parts = []
        for near in (np.repeat(first - 1, size), np.repeat(last, size)):
            i = np.flatnonzero((near >= 0) & (near < n))
            i = i[seed[i] == seed[near[i]]]
            j = near[i]
            right = _shared(behind[i], behind[j], np.minimum(n_behind[i], n_behind[j]))
            left = _shared(before[i], before[j], np.minimum(n_before[i], n_before[j]))
            ok = left + length + right >= least
            i, j, left, right = i[ok], j[ok], left[ok], right[ok]
            parts.append((doc[i], place[i] - left, place[i] + length + right, doc[j]))
        yield from _batches(parts, names)
        # the last row, and the last one of the document before, wait for the next batch
        keep = [int(first[-1]) - 1, n - 1] if first[-1] else [n - 1]
        held = [x[keep] for x in rows]


def neighbours(suffixes: DataFrame, least: int, window: int) -> DataFrame:
    """(doc_id, start, stop, other): matches of neighbours in suffix order, extended to both sides."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan(batches, least, window)

    order = ("key", "behind", "before", "lo", "start")
    placed = suffixes.repartitionByRange(partitions(suffixes.sparkSession), *order).sortWithinPartitions(*order)
    return placed.select("key", "lo", "start", "n_behind", "n_before", "behind", "before").mapInArrow(scan, SPANS)


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document as one; ``other`` is the least of their other documents."""
    spans = spans.groupBy("doc_id", "start", "stop").agg(F.min("other").alias("other"))
    by = Window.partitionBy("doc_id").orderBy("start", "stop")
    far = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.withColumn("new", F.coalesce(F.col("start") >= far, F.lit(True)).cast("int"))
    runs = cut.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("other").alias("other")).drop("run")


def repeated_passages(docs: DataFrame, least: int = LEAST, k: int = K, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, stop, n_words, other): spans of words that stand in another document too."""
    docs = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), utf8(text).alias("text"))
    rows = written(_suffixes(docs, least, k, window), "suffixes")
    whole = rows.filter(f"seed IS NULL AND stop >= {least}").select("doc_id", "text_key", F.col("stop").alias("n"))
    classes = checkpointed(whole.groupBy("text_key", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
    copied = classes.filter("rep <> last").select(F.col("text_key").alias("t"), F.col("n").alias("m"), "rep", "last")
    copies = whole.join(copied, (F.col("text_key") == F.col("t")) & (F.col("n") == F.col("m"))).select(
        "doc_id", F.lit(0).cast("bigint").alias("start"), F.col("n").alias("stop"), F.when(F.col("doc_id") == F.col("rep"), F.col("last")).otherwise(F.col("rep")).alias("other")
    )

    kept = rows.filter("seed IS NOT NULL")
    shared = kept.groupBy(F.col("seed").alias("s")).agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).filter("a <> b").select("s")
    shared = checkpointed(shared)  # both sides of the join get a shuffle of their own, whose hot keys can be split
    left = kept.join(shared, F.col("seed") == F.col("s"), "left_semi")
    reps = classes.select(F.col("rep").alias("r"), F.col("text_key").alias("t"), "last")
    left = left.join(reps, (F.col("doc_id") == F.col("r")) & (F.col("text_key") == F.col("t"))).drop("r", "t")
    left = checkpointed(left.withColumnRenamed("doc_id", "lo").withColumnRenamed("last", "hi").distinct())

    # ``lo`` is the row's document; where ``hi`` is another one, the class repeats as a whole already
    names = ("text_key", "place", "start", "stop", "seed")
    some = F.first(F.struct(F.col("lo").alias("doc_id"), *names)).alias("some")
    each = left.groupBy("block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), some).select("block", "lo", "hi", "some.*")
    each = checkpointed(each)
    twice = each.filter("lo <> hi").select(F.col("block").alias("x"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    at = F.when(F.col("lo") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other")
    inside = left.filter("lo = hi").join(twice, F.col("block") == F.col("x")).select(F.col("lo").alias("doc_id"), "start", "stop", at)

    open_ = checkpointed(each.groupBy(F.col("seed").alias("s")).agg(F.min("block").alias("a"), F.max("block").alias("b"), F.max(F.expr("lo = hi")).alias("o")).filter("a <> b AND o").select("s"))
    columns = ("doc_id", *names, "lo", "hi")
    # a document may have the same block at several places; all of them are asked if no other document has it
    single = each.filter("lo = hi").select(F.col("block").alias("x"))
    alone = left.join(open_, F.col("seed") == F.col("s"), "left_semi").join(single, F.col("block") == F.col("x"), "left_semi")
    alone = alone.withColumn("doc_id", F.col("lo")).select(*columns)
    more = each.filter("lo <> hi").join(open_, F.col("seed") == F.col("s"), "left_semi").select(*columns)
    texts = distinct_rows(docs, whole.select("doc_id"), "doc_id", "text")
    around = left.withColumn("doc_id", F.col("lo"))
    fetched = written(_fetched(texts, around, alone.unionAll(more), least, window), "fetched")
    sorted_ = neighbours(fetched.filter("NOT is_run"), least, window)
    runs = fetched.filter("is_run").select(F.col("key").alias("run"), "lo", "hi", "start")
    again = checkpointed(runs.groupBy(F.col("run").alias("x")).agg(F.min("lo").alias("a"), F.max("hi").alias("b")).filter("a <> b"))
    ends = runs.filter("lo = hi").join(again, F.col("run") == F.col("x"))
    ends = ends.select(F.col("lo").alias("doc_id"), "start", (F.col("start") + least).alias("stop"), at)

    found = _merged(copies.unionAll(sorted_).unionAll(inside).unionAll(ends))
    return found.select(F.col("doc_id").alias(key), "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "other")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
