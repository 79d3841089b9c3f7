"""Near duplicates by one-permutation MinHash (operator 3).

One hash per shingle: its high part picks a bin, the least hash of a bin is that bin's value, and an
empty bin borrows the value of the first filled bin in a fixed random order that depends on the
bin alone (optimal densification). ``bands`` groups of ``rows`` bins are the buckets. Two sets of
similarity s meet in no bucket with chance (1 - s^rows)^bands: 5e-6 at 0.8, 3e-9 at 0.85.

* Rows with equal shingle sets form one class, so exact copies cost one row each.
* In each bucket the least class is the hub of a star: one candidate edge per member, never a pair
  of each two members. Candidates are confirmed on whole sets.
* A star can miss a link between two members that are both unlike their hub. So for the classes of
  buckets that aren't one component after the stars, the links across components are found exactly:
  through the rarest shingles, one of which two sets so alike must share (``_open_pairs``). Groups of
  copies are one component by then and cost nothing; no bucket is capped.

Rows with null or empty text (or white space alone) have no shingles: they are linked with nothing
and kept. Rows without ``doc_id`` are kept, without component. Repeated rows share class and
component. Other columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm.common import checkpointed, table, utf8, written
from pageflow.llm.components import star_components
from pageflow.llm.words import mix, shingles

BANDS, ROWS = 40, 6
_ATTEMPTS = 64


def _order(bins: int) -> np.ndarray:
    """For each bin, the bins it asks in turn when it is empty."""
    return (mix(np.arange(bins * _ATTEMPTS, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64).reshape(_ATTEMPTS, bins)


def bin_minima(hashes: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """Densified one-permutation MinHash of a non-empty sorted set of hashes."""
    bin_of = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # rises with the hash
    first = np.flatnonzero(np.diff(bin_of.astype(np.int64), prepend=-1))
    where = bin_of[first].astype(np.int64)
    value = np.zeros(bins, np.uint64)
    value[where] = hashes[first]
    filled = np.zeros(bins, bool)
    filled[where] = True
    empty = np.flatnonzero(~filled)
    for asked in order:
        if not len(empty):
            return value
        donor = asked[empty]
        found = filled[donor]
        value[empty[found]] = value[donor[found]]
        empty = empty[~found]
    if len(empty):  # very few shingles: one of them, picked by the bin and the shingle alone
        weight = mix(hashes[first][None, :] ^ mix(empty.astype(np.uint64) + np.uint64(7))[:, None])
        value[empty] = hashes[first][weight.argmin(axis=1)]
    return value


def band_keys(hashes: np.ndarray, bands: int, rows: int, order: np.ndarray) -> np.ndarray:
    value = bin_minima(hashes, bands * rows, order).reshape(bands, rows)
    key = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))
    for k in range(rows):
        key = mix(key ^ value[:, k])
    return key.view(np.int64)


def _raw(texts: pa.Array):
    for x in texts:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def sketch(text, words: int, bands: int = BANDS, rows: int = ROWS) -> F.Column:
    """struct(n, set_key, bands) of a text: set size, 128-bit hash of the set, bucket keys."""

    @F.arrow_udf("struct<n: bigint, set_key: binary, bands: array<bigint>>")
    def make(texts: pa.Array) -> pa.Array:
        order = _order(bands * rows)
        n, key, band = [], [], []
        for raw in _raw(texts):
            s = shingles(raw, words)
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            band.append(band_keys(s, bands, rows, order) if len(s) else None)
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64()))],
            names=["n", "set_key", "bands"],
        )

    return make(utf8(text))


def shingle_set(text, words: int) -> F.Column:
    """The whole shingle set of a text as hashes."""

    @F.arrow_udf("array<bigint>")
    def make(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(raw, words).view(np.int64) for raw in _raw(texts)], pa.list_(pa.int64()))

    return make(utf8(text))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (u, v) those whose whole sets are alike enough."""
    a = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    either = F.size("a") + F.size("b") - both
    return pairs.join(a, "u").join(b, "v").filter(100 * both >= percent * either).select("u", "v")


def distinct_rows(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` (key, text) without repeated rows. Only ids that occur twice in ``ids`` are compared by text."""
    again = checkpointed(ids.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_again")))
    if not again.head(1):
        return docs
    same = docs[key].eqNullSafe(again["_again"])
    return docs.join(again, same, "left_anti").unionAll(docs.join(again, same, "left_semi").dropDuplicates([key, text]))


def _open_pairs(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(u, v) that may still be links, among the classes of buckets that aren't one component yet.

    With shingles ordered from rare to common, two sets alike enough share one of the first
    n - ceil(2p / (1 + p) * n) + 1 of the shorter and the first n - ceil(p * n) + 1 of the longer, where
    p is the least similarity. Shingles that no other of these classes has take up places but can't be
    shared; of edited copies they often take up all. From the first shared one on, both must have
    shingles enough left for the overlap.
    """
    named = members.join(roots, F.col("rep") == F.col("u"), "left").select("band", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = named.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select(F.col("band").alias("x"))
    left = checkpointed(named.join(mixed, F.col("band") == F.col("x"), "left_semi").select("rep", "root").distinct())
    own = left.join(sets.withColumnRenamed("rep", "w"), F.col("rep") == F.col("w")).select("rep", "root", "shingles")
    each = checkpointed(own.select("rep", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("t")))
    often = each.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1").withColumnRenamed("t", "s")
    rare = each.join(often, F.col("t") == F.col("s")).groupBy("rep", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("shared"))
    own_only = F.expr("n - size(shared)")
    short = F.expr(f"n - CAST(ceil({2 * percent} * n / {100 + percent}) AS INT) + 1") - own_only
    long = F.expr(f"n - CAST(ceil({percent} * n / 100) AS INT) + 1") - own_only
    rare = rare.withColumn("short", short).withColumn("long", long).filter("long > 0")
    first = rare.select("rep", "root", "n", "short", F.size("shared").alias("behind"), F.posexplode(F.expr("slice(shared, 1, long)")).alias("at", "x"))
    first = checkpointed(first.select("rep", "root", "n", F.col("x.t").alias("t"), (F.col("at") < F.col("short")).alias("short"), (F.col("behind") - F.col("at")).alias("left")))
    other = first.filter("short").select(F.col("t").alias("s"), F.col("rep").alias("hub"), F.col("root").alias("hub_root"), F.col("n").alias("hub_n"), F.col("left").alias("hub_left"))
    enough = F.expr(f"{100 + percent} * least(left, hub_left) >= {percent} * (n + hub_n)")
    longer = F.struct("n", "rep") > F.struct("hub_n", "hub")
    pairs = first.join(other, (F.col("t") == F.col("s")) & longer & (F.col("root") != F.col("hub_root")) & enough & F.expr(_fits(percent)))
    return pairs.select(F.greatest("rep", "hub").alias("u"), F.least("rep", "hub").alias("v")).distinct()


def _fits(percent: int) -> str:
    """Sets whose sizes differ by more than this can't be alike enough."""
    return f"rep <> hub AND 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row: components of the similarity links.

    ``key`` names documents: rows that share it share their links.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rowset = written(docs.select("doc_id", sketch(F.col("text"), words, bands, rows).alias("s")).select("doc_id", "s.*"), "sketch")
    usable = rowset.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")  # n and bands depend on the set alone

    # buckets with two classes at least, and a star around the least class of each
    each = classes.select("rep", "n", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    # written, so that the join below has a shuffle on both sides and a hot bucket can be split
    shared = checkpointed(shared.select(F.col("band").alias("b"), F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")))
    members = checkpointed(each.join(shared, F.col("band") == F.col("b")).select("band", "rep", "n", "hub", "hub_n"))
    pairs = checkpointed(members.filter(_fits(percent)).select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct())
    members = members.select("band", "rep")

    wanted = members.select(F.col("rep").alias("w")).distinct()
    texts = distinct_rows(docs.join(wanted, F.col("doc_id") == F.col("w"), "left_semi"), usable.select("doc_id"), "doc_id", "text")
    sets = written(texts.select(F.col("doc_id").alias("rep"), shingle_set(F.col("text"), words).alias("shingles")), "sets")

    links = checkpointed(_confirmed(pairs, sets, percent))
    rest = checkpointed(_open_pairs(members, sets, star_components(links), percent).join(pairs, ["u", "v"], "left_anti"))
    roots = star_components(links.unionAll(_confirmed(rest, sets, percent)))

    named = classes.join(roots, F.col("rep") == F.col("u"), "left").select(F.col("set_key").alias("k"), F.coalesce("root", "rep").alias("component"))
    named = checkpointed(named)  # a row per set; the join's other side can be split at hot sets
    out = rowset.select("doc_id", "n", "set_key").join(named, F.col("set_key") == F.col("k"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, the one of least ``key``, with the columns of ``docs``."""
    found = near_duplicates(docs, words, percent, key, text).filter("kept").select(F.col(key).alias("_kept_id")).distinct()
    kept = docs.join(found, docs[key].eqNullSafe(found["_kept_id"]), "left_semi")
    again = checkpointed(docs.filter(docs[key].isNotNull()).groupBy(key).count().filter("count > 1").select(F.col(key).alias("_again")))
    if not again.head(1):
        return kept
    twice = kept[key] == again["_again"]
    return kept.join(again, twice, "left_anti").unionByName(kept.join(again, twice, "left_semi").dropDuplicates([key]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs, words=5, percent=80)


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d
), n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS to_id FROM n UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.to_id = l.u)
SELECT n.doc_id, n.n AS n_shingles, min(r.to_id) AS component_id, n.doc_id = min(r.to_id) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
