"""Quality rules by compression bands (operator 9).

Repetitive text compresses too well, random text hardly at all. A document's Zstandard ratio (bytes
over compressed bytes) must lie inside a band that depends on its length, because longer texts
always compress better. The same holds for its fixed chunks, so that a repetitive part inside a
long normal text is seen as well: a document fails if too large a share of its chunk bytes
lies outside the chunk band.

``fit`` takes the bands from the corpus at hand: the ratios of all distinct texts that pass the base rule are
counted by language and half octave of length, and a band is the shortest interval that holds half of them,
widened by their own spread. Up to half of a class may so be noise or repetition without moving the band far, and copies
count once. A class of fewer than ``LEAST_TEXTS`` texts is joined with the next longer ones. Lengths between two classes are interpolated. Beyond the last one the upper limit goes on rising, and
below the first the lower one goes on falling. A language with fewer texts in all takes the bands of all languages together, and
a corpus with fewer the constants of ``Bands``. Fitted bands widen those constants and never narrow them, so that
a band of few lengths or of one uniform source can't reject ordinary text. The query and the pipeline's stage fit first, which reads the texts twice.

Verdicts are per row; only counts are shuffled. Null and empty texts have no words and fail the base rule. Rows
that repeat get the same result each; a null ``doc_id`` is passed on. Texts are read whole. Null languages, languages beyond the
``LANGUAGES`` most frequent ones and tables without the column take the bands of all languages together.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property
from math import exp, floor, inf, log, log2

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from pageflow.llm.common import table, utf8

SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")


@dataclass(frozen=True)
class Bands:
    """Limits on compression ratios. ``lengths[i]`` is the first byte length of band i + 1.

    They are the quantiles 0.001 and 0.999 of the texts of sf0.1 that are labelled clean and pass the base rule, 7%
    further out. Below 128 bytes and above 32,768 there are none: the first band has no lower limit, and the last
    takes the lower limit of the one before it and carries the upper ones on.
    """

    lengths: tuple[int, ...] = (128, 512, 2048, 8192, 32768)
    lowest: tuple[float, ...] = (0.0, 1.29, 1.37, 1.79, 2.06, 2.06)
    highest: tuple[float, ...] = (2.2, 1.96, 2.23, 2.49, 2.65, 2.75)
    chunk_bytes: int = 2048
    #: a shorter last chunk is joined to the one before it
    chunk_least: int = 512
    chunk_lowest: float = 1.37
    chunk_highest: float = 2.28
    #: largest share of bytes in chunks outside their band
    chunk_share: float = 0.25
    level: int = 3

    def whole(self, lang: str | None, size: int) -> tuple[float, float]:
        """Limits of a whole text of ``size`` bytes."""
        band = bisect_right(self.lengths, size)
        return self.lowest[band], self.highest[band]

    def chunk(self, lang: str | None, size: int) -> tuple[float, float]:
        return self.chunk_lowest, self.chunk_highest


#: Distinct texts of a band at least, and languages with bands of their own.
LEAST_TEXTS, LANGUAGES = 200, 64
#: Steps of log ratios that are counted; a band reaches REACH standard deviations, and FLOOR at least, from its middle.
STEP, REACH, FLOOR = 0.01, 4.5, 0.1
#: Change of log ratios per half octave of length, beyond the classes that have a band.
SLOPE = 0.05
#: The class of chunks, and the language name of all texts together.
CHUNKS, ALL = -1, ""


@dataclass(frozen=True)
class FittedBands(Bands):
    """Bands of a corpus: per language the (class, low, high) of log ratios, by class."""

    curves: tuple[tuple[str, tuple[tuple[float, float, float], ...]], ...] = ()

    @cached_property
    def _known(self) -> dict[str, tuple[tuple, tuple | None]]:
        """By language, the middles of its classes with their low and high, and the limits of chunks."""
        return {
            name: (tuple(zip(*((c + 0.5, low, high) for c, low, high in curve if c != CHUNKS), strict=True)), next((c[1:] for c in curve if c[0] == CHUNKS), None))
            for name, curve in self.curves
        }

    def _curve(self, lang: str | None) -> tuple[tuple, tuple | None]:
        return self._known.get(lang or ALL) or self._known.get(ALL) or ((), None)

    def whole(self, lang: str | None, size: int) -> tuple[float, float]:
        curve, _ = self._curve(lang)
        if not curve:
            return super().whole(lang, size)
        at, (x, lows, highs) = 2 * log2(max(size, 1)), curve
        low, high = float(np.interp(at, x, lows)), float(np.interp(at, x, highs))
        least, most = super().whole(lang, size)
        return min(least, exp(low - SLOPE * max(0.0, x[0] - at))), max(most, exp(high + SLOPE * max(0.0, at - x[-1])))

    def chunk(self, lang: str | None, size: int) -> tuple[float, float]:
        _, limits = self._curve(lang)
        if limits is None:
            return self.whole(lang, size) if self.curves else super().chunk(lang, size)
        low, high = limits
        least, most = super().chunk(lang, size)
        return min(least, exp(low - SLOPE * max(0.0, 2 * log2(self.chunk_bytes / max(size, 1))))), max(most, exp(high))


MEASURES = StructType(
    [
        StructField("n_words", LongType()),
        StructField("word_chars", LongType()),
        StructField("n_symbols", LongType()),
        StructField("n_dup_lines", LongType()),
        StructField("n_repeat_words", LongType()),
        StructField("base_failed", BooleanType()),
        StructField("kept", BooleanType()),
        StructField("ratio", DoubleType()),
        StructField("odd_share", DoubleType()),
    ]
)


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside n-word windows that occur at least twice in the text."""
    count = len(words) - n + 1
    if count < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    window = ids[:count]
    for k in range(1, n):  # ranks stay below the number of words, so the products fit
        _, rank = np.unique(window * len(number) + ids[k : k + count], return_inverse=True)
        window = rank.astype(np.int64)
    again = np.bincount(window)[window] > 1
    hit = np.zeros(len(words), bool)
    for k in range(n):
        hit[k : k + count] |= again
    return int(hit.sum())


def chunk_bounds(n: int, size: int, least: int) -> list[tuple[int, int]]:
    cuts = list(range(0, n, size))
    if len(cuts) > 1 and n - cuts[-1] < least:
        cuts.pop()
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def chunk_ratios(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> Iterator[tuple[int, int, float]]:
    """(start, stop, ratio) of each chunk that is judged."""
    for a, b in chunk_bounds(len(raw), bands.chunk_bytes, bands.chunk_least):
        if b - a >= bands.chunk_least:
            yield a, b, (b - a) / len(packer.compress(raw[a:b]))


def measure(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor, lang: str | None = None) -> tuple:
    """One row of MEASURES for a text in UTF-8."""
    words = raw.split()
    n = len(words)
    points = len(raw.decode("utf-8", "replace"))
    lines = [x for x in raw.split(b"\n") if x and x.split(None, 1)]
    repeat = repeated_words(words)
    failed = n < 50 or 100 * repeat > 50 * n
    ratio = odd = 0.0
    kept = not failed
    if raw:
        ratio = len(raw) / len(packer.compress(raw))
        for a, b, part in chunk_ratios(raw, bands, packer):
            low, high = bands.chunk(lang, b - a)
            odd += (b - a) * (not low <= part <= high)
        odd /= len(raw)
        low, high = bands.whole(lang, len(raw))
        kept = kept and low <= ratio <= high and odd <= bands.chunk_share
    spaces = sum(raw.count(x) for x in SPACES)
    symbols = sum(raw.count(x) for x in SYMBOLS)
    return n, points - spaces, symbols, len(lines) - len(set(lines)), repeat, failed, kept, ratio, odd


COUNTED = "lang string, class int, step int, print bigint"


def _counted(raw: bytes, lang: str, bands: Bands, packer: zstandard.ZstdCompressor) -> Iterator[tuple]:
    """A row of COUNTED for a text that passes the base rule, and for each of its whole chunks."""
    words = raw.split()
    if len(words) < 50 or 100 * repeated_words(words) > 50 * len(words):
        return
    step = lambda ratio: floor(log(ratio) / STEP)
    named = lambda part: xxhash.xxh3_64_intdigest(part) - (1 << 63)
    yield lang, floor(2 * log2(len(raw))), step(len(raw) / len(packer.compress(raw))), named(raw)
    for a, b, ratio in chunk_ratios(raw, bands, packer):
        if b - a >= bands.chunk_bytes:
            yield lang, CHUNKS, step(ratio), named(raw[a:b])


def _band(steps: list[tuple[int, int]]) -> tuple[float, float]:
    """Limits of log ratios from (step, texts): the shortest interval with half of the texts, widened."""
    steps = sorted(steps)
    least = sum(n for _, n in steps) / 2
    width, middle, first, held = inf, 0.0, 0, 0
    for step, n in steps:
        held += n
        while held - steps[first][1] >= least:
            held -= steps[first][1]
            first += 1
        if held >= least and step + 1 - steps[first][0] < width:
            width, middle = step + 1 - steps[first][0], (step + 1 + steps[first][0]) / 2
    # half of a normal distribution lies within 0.6745 standard deviations
    reach = max(FLOOR, REACH * width / 2 * STEP / 0.6745)
    return middle * STEP - reach, middle * STEP + reach


def _curve_of(sizes: dict[int, dict[int, int]]) -> tuple[tuple[float, float, float], ...]:
    """(class, low, high) of (class, step) counts; classes join the next ones until they hold ``LEAST_TEXTS`` texts."""
    curve, steps, place = [], defaultdict(int), 0
    for size, counts in sorted(sizes.items()):
        for step, n in counts.items():
            steps[step] += n
            place += size * n
        texts = sum(steps.values())
        if texts >= LEAST_TEXTS:
            curve.append((place / texts, *_band(list(steps.items()))))
        if texts >= LEAST_TEXTS or size == CHUNKS:
            steps, place = defaultdict(int), 0
    return tuple(curve)


def _lang(docs: DataFrame, lang: str | None) -> F.Column:
    return F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")


def fit(docs: DataFrame, text: str = "text", lang: str | None = "lang", bands: Bands | None = None) -> Bands:
    """The bands of all distinct texts of ``docs`` that pass the base rule.

    The driver sees the counts alone: (``LANGUAGES`` + 1) x classes x steps at most, whatever the corpus.
    """
    bands = bands or Bands()
    rows = docs.select(utf8(text).alias("t"), _lang(docs, lang).alias("l"))
    by = rows.filter("l <> ''").groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES)
    names = {r.l for r in by.collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            out: list[tuple] = []
            for raw, of in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if raw.is_valid:
                    out.extend(_counted(raw.as_buffer().to_pybytes(), of if of in names else ALL, bands, packer))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "class", "step", "print"])

    each = rows.mapInArrow(count, COUNTED).distinct().groupBy("lang", "class", "step").count()
    found: dict[str, dict[int, dict[int, int]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for of, size, step, n in each.collect():
        for name in {of, ALL}:
            found[name][size][step] += n
    curves = {name: _curve_of(sizes) for name, sizes in found.items()}
    curves = {name: curve for name, curve in curves.items() if any(c[0] != CHUNKS for c in curve)}
    return FittedBands(**{f.name: getattr(bands, f.name) for f in fields(Bands)}, curves=tuple(sorted(curves.items())))


def quality(text: str = "text", bands: Bands | None = None, lang: F.Column | None = None) -> F.Column:
    """The measures and the verdict of a text column as a struct."""
    bands = bands or Bands()

    @F.arrow_udf(MEASURES)
    def judge(texts: pa.Array, langs: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=bands.level)
        rows = [measure(x.as_buffer().to_pybytes() if x.is_valid else b"", bands, packer, of) for x, of in zip(texts, langs.to_pylist(), strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * len(MEASURES)
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        kinds["bigint"] = kinds["long"]
        return pa.StructArray.from_arrays(
            [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, MEASURES, strict=True)],
            names=MEASURES.names,
        )

    return judge(utf8(text), F.lit(None).cast("string") if lang is None else lang)


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands | None = None, lang: str | None = "lang") -> DataFrame:
    """``key`` and the measures of each row."""
    return docs.select(key, quality(text, bands, _lang(docs, lang)).alias("_m")).select(key, "_m.*")


def keep_good(docs: DataFrame, text: str = "text", bands: Bands | None = None, lang: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    name = "_verdict_" + "_".join(docs.columns)
    return docs.withColumn(name, quality(text, bands, _lang(docs, lang))["kept"]).filter(F.col(name)).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return measures(docs, bands=fit(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, bands=fit(docs))
