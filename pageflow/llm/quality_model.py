"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 6).

Statistics of whole texts (shares of letters, digits, signs and capitals, word and line lengths, repetition,
entropy) are cut into bins at quantiles of the training rows. The trees are fitted on the driver over
a bounded sample of the labelled rows, ``SAMPLE`` at most, the ones with the least hash of their id, and
only rows whose crc32(doc_id) mod 3 isn't 1. Scoring is one pass without a shuffle: the
flattened arrays go to every task, which moves a batch of rows through all trees one level at a time.

A score is a function of the text alone. Null texts count as empty; they, and empty ones, get the score of
their statistics (all zero). Labels that are null, of other values or contradictory are left out. With no usable
label of both classes the score is the share of ones, or a half. Repeated rows get the same score each.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm.boosting import Trees, fit
from pageflow.llm.common import table, utf8

#: Labelled rows the trees are fitted on, at most, and bins per statistic.
SAMPLE, BINS = 20_000, 64

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 stop, 7 sign, 8 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[128:] = 1, 2, 3, 4, 5, 8
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 6
_CLASS[[ord(c) for c in "#*$%&|<>{}[]\\/_=+~^@`"]] = 7

NAMES = (
    "bytes", "words", "lines", "lower", "upper", "digit", "space", "stop", "sign", "wide", "odd", "word_mean", "word_dev", "word_most",
    "distinct", "top_word", "pair_again", "triple_again", "line_mean", "line_again", "line_end", "entropy", "word_entropy",
    "caps_words", "sign_words", "digit_words", "long_words", "stop_ends", "bang", "pipe",
)


def statistics(raw: bytes) -> list[float]:
    """The statistics of a text in UTF-8, in the order of NAMES."""
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, at, 9) / n
    p = at[at > 0] / n
    words = raw.split()
    w = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out = [math.log1p(n), math.log1p(w), math.log1p(len(lines)), kinds[1], kinds[2], kinds[3], kinds[4] + kinds[5], kinds[6], kinds[7], kinds[8], kinds[0]]
    if w:
        sizes = np.fromiter(map(len, words), np.int64, w)
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, w)
        count = np.bincount(ids)
        share = count / w
        out += [sizes.mean(), sizes.std(), math.log1p(sizes.max()), len(count) / w, share.max()]
        gram = ids
        for k in (1, 2):
            if w > k:
                _, rank, size = np.unique(gram[: w - k] * len(number) + ids[k:], return_inverse=True, return_counts=True)
                gram = rank
                out.append(float((size[rank] > 1).mean()))
            else:
                out.append(0.0)
    else:
        out += [0.0] * 7
    again = Counter(lines)
    out += [math.log1p(n / max(1, len(lines))), 1 - len(again) / max(1, len(lines)), sum(x.rstrip()[-1:] in b".!?\"" for x in lines) / max(1, len(lines))]
    out.append(float(-(p * np.log2(p)).sum()))
    if w:
        out.append(float(-(share * np.log2(share)).sum()))
        out.append(sum(x.isupper() for x in words) / w)
        out.append(sum(x[-1:] in _SIGNS for x in words) / w)
        out.append(sum(x.isdigit() for x in words) / w)
        out.append(float((sizes > 16).mean()))
        out.append(sum(x[-1:] in b".,;:!?" for x in words) / w)
    else:
        out += [0.0] * 6
    return [*map(float, out), at[33] / n, at[124] / n]


_SIGNS = b"#*$%&|<>{}[]\\/_=+~^@`!"


def stats_matrix(texts: pa.Array) -> np.ndarray:
    rows = [statistics(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in texts]
    return np.array(rows, float).reshape(-1, len(NAMES))


def statistics_column(text) -> F.Column:
    @F.arrow_udf("array<double>")
    def make(texts: pa.Array) -> pa.Array:
        return pa.array(list(stats_matrix(texts)), pa.list_(pa.float64()))

    return make(utf8(text))


class Model:
    """Bin edges and trees; ``score`` is the probability of label 1."""

    def __init__(self, edges: list[np.ndarray], trees: Trees):
        self.edges, self.trees = edges, trees

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        bins = np.stack([np.searchsorted(e, stats[:, k], "left") for k, e in enumerate(self.edges)], axis=1)
        return self.trees.probability(bins)


def fit_model(stats: np.ndarray, label: np.ndarray, bins: int = BINS, trees: int = 150, depth: int = 4) -> Model:
    if not len(stats):
        stats, label = np.zeros((2, len(NAMES))), np.array([0, 1])
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in stats.T]
    binned = np.stack([np.searchsorted(e, stats[:, k], "left") for k, e in enumerate(edges)], axis=1)
    return Model(edges, fit(binned, label, np.ones(len(label)), trees=trees, depth=depth, rate=0.1, least=8))


def held_out(key) -> F.Column:
    """Rows whose labels are never learnt from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "utf-8")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from at most ``sample`` labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    usable = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "quality")
    # the sample has a fixed size, so its ids may go to every task
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id"))
    seen = rows.select("doc_id", "quality", statistics_column("text").alias("s")).groupBy("doc_id", "quality", "s").count().orderBy("doc_id", "s").limit(2 * sample).collect()
    return fit_model(np.array([r.s for r in seen], float).reshape(-1, len(NAMES)), np.array([r.quality for r in seen], np.int64))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(stats_matrix(texts)), pa.float64())

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), judge(utf8("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
