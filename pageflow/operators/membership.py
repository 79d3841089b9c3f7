"""Bloom filters in columns: which keys are surely not in a table, without reading it.

A filter is an array of 64-bit words, made by a ``bit_or`` per word with map-side combine, and asked with ``bit_get``: no
Python, no driver. A key sets ``HASHES`` bits, spread by two 64-bit hashes of its columns; with ``BITS_PER_KEY`` bits a
key about one absent key in a hundred is a maybe, and no present key is ever missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, HASHES, LEAST_WORDS = 10, 7, 16


def words_for(rows: int) -> int:
    """Words of a filter over so many keys."""
    return max(LEAST_WORDS, -(-rows * BITS_PER_KEY // 64))


def bit_places(key: list[str], n_words: Column) -> Column:
    """The bits of a key in a filter of ``n_words`` words."""
    first, second = F.xxhash64(*key), F.xxhash64(F.lit(0x5EED), *key)
    bits = n_words.cast("long") * 64
    # shifted to the right first, so that sums don't overflow
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.pmod(F.shiftrightunsigned(first, 4) + i * F.shiftrightunsigned(second, 8), bits))


def bloom_filters(rows: DataFrame, group: str, key: list[str], sizes: DataFrame) -> DataFrame:
    """(group, words) for each group of ``sizes`` (group, n_words): the filter of its rows' keys. A hot group is combined
    before it is shuffled; a group's words are one row."""
    bits = rows.join(F.broadcast(sizes), group).select(group, F.explode(F.array_distinct(bit_places(key, F.col("n_words")))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    set_ = bits.select(group, F.expr("bit div 64").alias("word"), one.alias("bits"))
    empty = sizes.select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_words").cast("long") - 1)).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_.unionByName(empty).groupBy(group, "word").agg(F.bit_or("bits").alias("bits"))
    held = words.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    return held.select(group, F.col("w.bits").alias("words"))


def may_hold(words: str, key: list[str]) -> Column:
    """False only where the filter's table surely lacks the key. A null filter holds nothing."""
    places = bit_places(key, F.size(words))
    hit = lambda b: F.call_function("bit_get", F.get(F.col(words), F.shiftright(b, 6).cast("int")), (b % 64).cast("int")) == 1
    return F.coalesce(F.when(F.col(words).isNotNull(), F.forall(places, hit)), F.lit(False))
