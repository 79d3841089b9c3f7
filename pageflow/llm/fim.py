"""Fill-in-middle transformation with a piece table (operator 13).

A document is a list of descriptors (buffer, start, length) over two buffers that nobody changes: its text in
UTF-8 and the sentinels. Two cuts split the text's descriptor into prefix, middle and suffix; an arrangement
permutes descriptors of text and sentinels; the inverse permutation restores the document from an output, whose
sentinels say where its descriptors begin. Digests read the buffers through the descriptors; bytes are put
together only where a text is asked for.

Cuts, and whether and how a document is arranged, follow from a digest of ``seed`` and the document's id, so a
repeated task makes the same output. A unit is a code point (a byte that doesn't continue one, so texts that
aren't UTF-8 have units as well and come back byte for byte).

Null texts count as empty; empty texts and texts that contain a sentinel stay plain, as do a share of all others.
A null id is digested as an empty one. Repeated rows are documents of their own, ties don't arise, other columns
aren't read, and an empty table gives an empty result. A task holds one text (and its output) at a time beside an
Arrow batch, and finds code points a megabyte at a time, so very long texts need no larger tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm.common import table, utf8

TEXT, MARKS = 0, 1
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
CHUNK = 1 << 20
OUTPUT_BYTES = 1 << 24
#: Piece numbers (0 to 2: prefix, middle, suffix; 3 to 5: their sentinels) in the order of each form's output.
ARRANGEMENTS = {"psm": (3, 0, 5, 2, 4, 1), "spm": (5, 2, 3, 0, 4, 1)}


@dataclass(frozen=True)
class Settings:
    """``plain_from``: documents whose third number modulo 100 is at least this stay plain. ``spm_below``: of the others,
    those whose fourth number modulo 100 is below this come suffix first."""

    seed: int = 1
    plain_from: int = 90
    spm_below: int = 20
    prefix: str = "<P>"
    middle: str = "<M>"
    suffix: str = "<S>"

    def __post_init__(self):
        marks = (self.prefix, self.middle, self.suffix)
        for i, x in enumerate(marks):
            if not x:
                raise ValueError("a sentinel is empty")
            for j, y in enumerate(marks):
                # a sentinel that lies in another, or whose end begins one, could not be told apart
                if (i != j and y in x) or any(x.endswith(y[:k]) for k in range(1, min(len(x), len(y)))):
                    raise ValueError(f"sentinels {x!r} and {y!r} overlap")

    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.middle.encode(), self.suffix.encode()


@dataclass(frozen=True)
class Piece:
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over immutable buffers. Cutting and permuting move descriptors, never bytes."""

    def __init__(self, text: bytes, marks: bytes = b""):
        self.buffers = (memoryview(text), memoryview(marks))
        self.pieces = [Piece(TEXT, 0, len(text))]

    def cut(self, at: int) -> None:
        """Splits the descriptor that holds place ``at`` of the whole in two; the second one starts there."""
        before = 0
        for k, p in enumerate(self.pieces):
            if at <= before + p.length and (at < before + p.length or k + 1 == len(self.pieces)):
                n = at - before
                self.pieces[k : k + 1] = [Piece(p.buffer, p.start, n), Piece(p.buffer, p.start + n, p.length - n)]
                return
            before += p.length
        raise ValueError(f"no place {at}")

    def add_marks(self, lengths: list[int]) -> None:
        at = 0
        for n in lengths:
            self.pieces.append(Piece(MARKS, at, n))
            at += n

    def permute(self, order: tuple[int, ...]) -> None:
        self.pieces = [self.pieces[k] for k in order]

    def stream(self) -> Iterator[memoryview]:
        for p in self.pieces:
            yield self.buffers[p.buffer][p.start : p.start + p.length]

    def digest(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.stream())


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    back = [0] * len(order)
    for place, k in enumerate(order):
        back[k] = place
    return tuple(back)


class Units:
    """The code points of a text in UTF-8: their number, and where the k-th starts."""

    def __init__(self, raw: bytes):
        self.raw, self.plain = raw, raw.isascii()
        if self.plain:
            self.count = len(raw)
        else:
            self.before = np.cumsum([0] + [int(np.count_nonzero(self._starts(a))) for a in range(0, len(raw), CHUNK)])
            self.count = int(self.before[-1])

    def _starts(self, at: int) -> np.ndarray:
        return (np.frombuffer(self.raw, np.uint8, min(CHUNK, len(self.raw) - at), at) & 0xC0) != 0x80

    def place(self, k: int) -> int:
        """The byte at which unit ``k`` starts; the end for the number of units, the start for 0."""
        if self.plain or k == 0:
            return k
        if k >= self.count:
            return len(self.raw)
        chunk = int(np.searchsorted(self.before, k, "right")) - 1
        return chunk * CHUNK + int(np.flatnonzero(self._starts(chunk * CHUNK))[k - int(self.before[chunk])])


def numbers(seed: int, key: int | None) -> list[int]:
    """The first four 8-digit groups of the digest of seed and id, as unsigned integers."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def arranged(raw: bytes, key: int | None, settings: Settings) -> tuple[int, str, int | None, int | None, PieceTable]:
    """(units, form, units of the prefix, units of the middle, table) of a document."""
    units, marks = Units(raw), settings.marks()
    h1, h2, h3, h4 = numbers(settings.seed, key)
    n = units.count
    if not raw or any(m in raw for m in marks) or h3 % 100 >= settings.plain_from:
        return n, "plain", None, None, PieceTable(raw)
    form = "spm" if h4 % 100 < settings.spm_below else "psm"
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    held = PieceTable(raw, b"".join(marks))
    held.cut(units.place(b))
    held.cut(units.place(a))
    held.add_marks([len(m) for m in marks])
    held.permute(ARRANGEMENTS[form])
    return n, form, a, b - a, held


def restored_table(output: bytes, form: str, settings: Settings) -> PieceTable:
    """The document of an output: its pieces found by their sentinels, put back by the inverse permutation."""
    held = PieceTable(output)
    if form == "plain":
        return held
    order, marks, pieces, at = ARRANGEMENTS[form], settings.marks(), [], 0
    found = [output.index(marks[order[0] - 3])]
    for k in order[2::2]:
        found.append(output.index(marks[k - 3], found[-1] + 1))
    for k, place in zip(order[::2], found, strict=True):
        if pieces:
            pieces.append(Piece(TEXT, at, place - at))
        at = place + len(marks[k - 3])
        pieces.append(Piece(TEXT, place, at - place))
    held.pieces = [*pieces, Piece(TEXT, at, len(output) - at)]
    held.permute(inverse(order)[:3])
    return held


MADE = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary, output_sha256 string, pieces array<struct<buffer:int,start:bigint,length:bigint>>"
_PIECE = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(_PIECE))
_NAMES = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "pieces")


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row per document: its form, cuts, output (in UTF-8), the output's digest and its descriptors."""
    settings = settings or Settings()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=list(_NAMES))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for key_, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                n, form, prefix, middle, held = arranged(raw, key_, settings)
                out = held.text()
                rows.append((key_, n, form, prefix, middle, out, held.digest(), [vars(p) for p in held.pieces]))
                size += len(out)
                if size >= OUTPUT_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), utf8(text).alias("text")).mapInArrow(make, MADE)


def restored(output: str = "output", form: str = "form", settings: Settings | None = None) -> F.Column:
    """(text, sha256) of the document that an output and its form give back."""
    settings = settings or Settings()

    @F.arrow_udf("struct<text: binary, sha256: string>")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        held = [restored_table(o.as_buffer().to_pybytes(), f, settings) for o, f in zip(outputs, forms.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array([h.text() for h in held], pa.binary()), pa.array([h.digest() for h in held], pa.string())], names=["text", "sha256"]
        )

    return back(utf8(output), F.col(form))


def restored_digest(output: str = "output", form: str = "form", settings: Settings | None = None) -> F.Column:
    """The digest alone, streamed over the output's descriptors: no text is put together."""
    settings = settings or Settings()

    @F.arrow_udf("string")
    def back(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        rows = zip(outputs, forms.to_pylist(), strict=True)
        return pa.array([restored_table(o.as_buffer().to_pybytes(), f, settings).digest() for o, f in rows], pa.string())

    return back(utf8(output), F.col(form))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return made.select(*names, restored_digest().alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT *, (('0x' || substr(h, 1, 8))::UBIGINT % (n + 1)::UBIGINT)::BIGINT AS c1, (('0x' || substr(h, 9, 8))::UBIGINT % (n + 1)::UBIGINT)::BIGINT AS c2,
    ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS c3, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS c4 FROM d
), f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), o AS (
  SELECT *, '<P>' || substr(t, 1, a) AS p, '<M>' || substr(t, a + 1, b - a) AS m, '<S>' || substr(t, b + 1) AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
