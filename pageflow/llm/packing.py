"""Best-fit packing of token sequences (operator 2).

Texts become token ids (each document ends with id 2). A document longer than a sequence is cut into
full pieces behind a first, shorter one; nothing else is cut. Pieces are packed best-fit decreasing:
longest first, each into the open sequence with the least room that still holds it. A segment tree
over the remaining capacities finds that capacity in logarithmic time.

At scale the pieces, as narrow rows (ids stay behind), are dealt out by hash into bins' worth of
``GROUP_PIECES`` pieces each; every group is packed by itself in one task of bounded memory. A group of
that many pieces leaves at most a few sequences unfilled, so the loss against one global packing is
a small constant per group. Full pieces are a sequence each and take no part.

Null texts count as empty (a document of id 2 alone). Bytes that aren't UTF-8 are read as the replacement character.
Very long texts, also a single run of white space, are coded whole. Repeated rows and null ids are documents of their
own; order within a group is fixed by (length, key, piece), so a repeated task packs the same.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm.common import table, utf8, written

CAPACITY, END_ID, GROUP_PIECES = 1024, 2, 100_000

#: The vocabulary's special string, and the length from which a run of one kind (white space, or none) is left to ``tokenizers``.
SPECIAL, LONG_RUN = "<|endoftext|>", 100_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Coder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as ``tokenizers`` gives them with ``path`` and
    ``add_special_tokens=False`` (a special string inside a text is its one id).

    Texts without special strings and very long runs take another way to the same ids (compared in the tests): the
    vocabulary's rank file, a few times faster. That library can't get through a million white-space characters.
    """

    def __init__(self, path: str, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        import tokenizers

        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.run = re.compile(rf"\s{{{LONG_RUN},}}|\S{{{LONG_RUN},}}")

    def ids(self, text: str) -> bytes:
        if SPECIAL in text or (len(text) >= LONG_RUN and self.run.search(text)):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


_HELD: dict[str, Coder] = {}


def _coder(path: str) -> Coder:
    if path not in _HELD:  # once per Python worker
        _HELD[path] = Coder(path)
    return _HELD[path]


def bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: the first may be shorter than the others."""
    first = n % capacity or capacity
    cuts = [0, *range(first, n + 1, capacity)]
    return list(zip(cuts, cuts[1:], strict=False))


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document with their ids (little-endian unsigned 32-bit)."""
    path = path or vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = part.column(0).to_pylist()
                out: list[tuple] = []
                for k, raw in zip(keys, part.column(1).to_pylist(), strict=True):
                    raw = coder.ids((raw or b"").decode("utf-8", "replace")) + end
                    for p, (a, b) in enumerate(bounds(len(raw) // 4, capacity)):
                        ids = raw[4 * a : 4 * b]
                        out.append((k, p, a, b - a, zlib.crc32(ids), ids))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), utf8(F.col(text).cast("string")).alias("text")).mapInArrow(cut, PIECES)


class Capacities:
    """Segment tree over the remaining capacities 0..size; a leaf counts the open bins with that room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, least: int) -> int:
        """The smallest room of at least ``least`` that some open bin has, or -1."""
        node, count = self.leaves + least, self.count
        if count[node]:
            return least
        while node > 1:  # up to the first right neighbour that has bins, then down to its leftmost leaf
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length. The lengths come longest first."""
    tree = Capacities(capacity)
    open_bins: dict[int, list[int]] = {}
    bins, offsets, made = [], [], 0
    for n in lengths:
        room = tree.tightest(n)
        if room < 0:
            b, room, made = made, capacity, made + 1
        else:
            b = open_bins[room].pop()
            tree.add(room, -1)
        bins.append(b)
        offsets.append(capacity - room)
        if room > n:
            open_bins.setdefault(room - n, []).append(b)
            tree.add(room - n, 1)
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    stored = written(parts.select(*names), "pieces")
    groups = 1 + stored.filter(F.col("length") < capacity).count() // group_pieces

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        keys = [("length", "descending"), *((n, "ascending") for n in ("doc_id", "piece", "start", "ids_crc32"))]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys))
        bins, offsets = best_fit(rows.column("length").to_pylist(), capacity)
        first = TaskContext.get().partitionId() << 32
        columns = [rows.column(n).combine_chunks() for n in names]
        columns += [pa.array(np.array(bins, np.int64) + first), pa.array(offsets, pa.int64())]
        yield from pa.Table.from_arrays(columns, names=[*names, "sequence_id", "offset"]).to_batches(max_chunksize=10_000)

    dealt = stored.filter(F.col("length") < capacity).repartition(groups, F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()))
    packed = dealt.mapInArrow(place, schema)
    full = stored.filter(F.col("length") >= capacity).select(
        *names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return packed.unionByName(full)


def sequences(parts: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_pieces): the packed sequences themselves, for distinct (doc_id, piece)."""
    both = placed.select("doc_id", "piece", "sequence_id", "offset").join(parts.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    row = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(row, F.lit(b"").cast("binary"), lambda a, r: F.concat(a, r["ids"]))
    return both.groupBy("sequence_id").agg(joined.alias("ids"), F.count("*").alias("n_pieces"))


def packed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(docs, key, text, path, capacity, end_id), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)
