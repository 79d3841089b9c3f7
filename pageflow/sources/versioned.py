"""A table with one row per key that batches change: insert, replace, or insert-or-ignore, also from a stream.

Rows lie in hash buckets of their key. A batch is reduced to one row per key, written, and merged with the buckets
that it touches; these are written anew and a commit names, for each bucket, the folder that holds it now. Readers
see whole versions only. A commit also carries the batch's id, so a batch that is replayed after a failure changes
nothing, and one that failed before its commit is merged again from the version it started with.

Which row of a key stays is decided by ``order`` alone (the largest tuple of these columns, then of the others), so
late and repeated rows give the same table in any order of arrival.

With ``filters`` a Bloom filter of each bucket's keys is kept beside it. A membership test then reads the filters
(10 bits a key) of the buckets it touches, and the rows of the table only for keys that may be there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.operators.membership import bloom_filters, may_hold, words_for
from pageflow.sources.commits import CommitLog

BUCKET = "state_bucket"
#: Bytes of filters that a membership test may broadcast (their size is known from the commit); more are joined by bucket.
FILTER_BROADCAST = 32 << 20


class VersionedTable:
    """``schema`` is a DDL string; ``order`` are the columns that rank the rows of a key (none: the key is all there is).
    The number of buckets is fixed by the first writer: a batch costs the buckets it touches, each one task's work."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], order: list[str] | None = None, buckets: int = 64, filters: bool = False):
        self.spark, self.folder, self.schema, self.key, self.order = spark, folder.rstrip("/"), schema, key, order or []
        self.commits = CommitLog(spark, f"{self.folder}/commits")
        self.columns = spark.createDataFrame([], schema).columns
        last = self.commits.last()
        first = self.commits.read(last) if last is not None else {"buckets": buckets, "filters": {} if filters else None}
        self.buckets, self.filtered = first["buckets"], first["filters"] is not None

    def version(self) -> int | None:
        return self.commits.last()

    def _state(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return {"batch": None, "buckets": self.buckets, "folders": {}, "filters": {} if self.filtered else None} if version is None else self.commits.read(version)

    def batch(self) -> int | None:
        """The id of the last batch that is part of the table."""
        return self._state()["batch"]

    def _rows(self, folders: dict[str, str], wanted: set[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{p}" for b, p in sorted(folders.items()) if wanted is None or int(b) in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._state(version)["folders"])

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _one_per_key(self, df: DataFrame) -> DataFrame:
        """One row per key and bucket; rows of a hot key are combined before they are shuffled."""
        by = [BUCKET, *self.key]
        others = [c for c in self.columns if c not in (*self.key, *self.order)]
        if not self.order and not others:
            return df.select(*by).distinct()
        return df.groupBy(*by).agg(F.max(F.struct(*self.order, *others)).alias("_w")).select(*by, "_w.*")

    def touched(self, df: DataFrame) -> set[int]:
        """The buckets of a table's rows: at most as many numbers as there are buckets."""
        return {r[0] for r in df.select(BUCKET).distinct().collect()}

    def merge(self, rows: DataFrame, batch_id: int) -> bool:
        """Merges a batch and commits; False if it (or a later one) is part of the table already."""
        state, version = self._state(), self.version()
        if state["batch"] is not None and batch_id <= state["batch"]:
            return False
        name = f"{(0 if version is None else version + 1):012d}-{uuid.uuid4().hex}"
        delta_path = f"{self.folder}/deltas/{name}"
        self._one_per_key(self._bucketed(rows.select(*self.columns))).write.parquet(delta_path)
        delta = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(delta_path)
        touched = self.touched(delta)
        folders = dict(state["folders"])
        if touched:
            both = self._bucketed(self._rows(folders, touched)).unionByName(delta)
            # one shuffle: rows dealt by bucket are also together by key
            merged = self._one_per_key(both.repartition(len(touched), BUCKET))
            merged.select(*self.columns, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/data/{name}")
            folders |= {str(b): f"data/{name}/{BUCKET}={b}" for b in touched}
        filters = self._new_filters(state["filters"], folders, touched, name) if self.filtered else None
        self.commits.commit(0 if version is None else version + 1, {"batch": batch_id, "buckets": self.buckets, "folders": folders, "filters": filters})
        return True

    def _new_filters(self, held: dict, folders: dict[str, str], touched: set[int], name: str) -> dict:
        """[folder, words] by bucket: filters of the touched buckets made from their new rows."""
        if not touched:
            return held
        rows = self._bucketed(self._rows(folders, touched).select(*self.key))
        counts = {r[0]: r[1] for r in rows.groupBy(BUCKET).count().collect()}  # a number per bucket
        sizes = self.spark.createDataFrame([(b, words_for(n)) for b, n in counts.items()], f"{BUCKET} int, n_words int")
        made = bloom_filters(rows, BUCKET, self.key, sizes).withColumn("held", F.col(BUCKET))
        made.repartition(len(touched), BUCKET).write.partitionBy("held").parquet(f"{self.folder}/filters/{name}")
        return held | {str(b): [f"filters/{name}/held={b}", words_for(n)] for b, n in counts.items()}

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows whose key the table surely lacks, rows whose key it may have), by the buckets' filters."""
        keyed = self._bucketed(df)
        wanted = {str(b) for b in self.touched(keyed)}
        held = {b: f for b, f in (self._state()["filters"] or {}).items() if b in wanted}
        if not held:
            return df, df.limit(0)
        filters = self.spark.read.schema(f"{BUCKET} int, words array<bigint>").parquet(*[f"{self.folder}/{p}" for p, _ in held.values()])
        if 8 * sum(n for _, n in held.values()) <= FILTER_BROADCAST:
            filters = F.broadcast(filters)
        asked = keyed.join(filters.withColumnRenamed("words", "state_words"), BUCKET, "left").withColumn("state_maybe", may_hold("state_words", self.key))
        return asked.filter("NOT state_maybe").select(*df.columns), asked.filter("state_maybe").select(*df.columns)

    def lacking(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose key the table lacks. Only the buckets that ``df`` touches are read, and with filters only rows
        that may be there are shuffled and joined."""
        absent, maybe = self.split(df) if self.filtered else (df.limit(0), df)
        held = self._rows(self._state()["folders"], self.touched(self._bucketed(maybe))).select(*self.key)
        exact = maybe.join(held, self.key, "left_anti").select(*df.columns)
        return absent.unionByName(exact) if self.filtered else exact

    def having(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose key the table has."""
        maybe = self.split(df)[1] if self.filtered else df
        held = self._rows(self._state()["folders"], self.touched(self._bucketed(maybe))).select(*self.key)
        return maybe.join(held, self.key, "left_semi").select(*df.columns)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what none of the last ``keep`` versions needs, and the deltas; returns the number of folders.
        For the one writer, between batches."""
        numbers = self.commits.numbers()
        states = [self.commits.read(n) for n in numbers[-keep:]]
        held = {p for x in states for p in x["folders"].values()} | {p for x in states for p, _ in (x["filters"] or {}).values()}
        fs, gone = self.commits.fs, 0
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        for top in ("data", "filters", "deltas"):
            if not fs.exists(at(f"{self.folder}/{top}")):
                continue
            for run in [s.getPath() for s in fs.listStatus(at(f"{self.folder}/{top}"))]:
                parts = [p for p in (s.getPath() for s in fs.listStatus(run)) if "=" in p.getName()] if top != "deltas" else []
                dead = [p for p in parts if f"{top}/{run.getName()}/{p.getName()}" not in held]
                alive = len(parts) - len(dead)
                for p in dead if alive else [run]:
                    fs.delete(p, True)
                    gone += 1
        for n in numbers[:-keep]:
            fs.delete(at(f"{self.commits.folder}/{n:012d}.json"), False)
        return gone
