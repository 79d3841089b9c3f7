"""Tables in hash buckets that a job joins again and again: one that stays as it is, and one that grows.

Rows lie in the buckets of their keys, so a join shuffles its other side only. A growing table is a few tiers
(a log-structured merge): an addition is one file in each bucket that gets rows; ``FAN`` additions of a tier are
merged, bucket by bucket and without a shuffle, into one addition to the next tier. A bucket has thus at most
``FAN`` files per tier, and the tiers grow with the logarithm of the additions.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from pageflow.session import checkpoint_dir
from pageflow.sources.commits import file_system

FAN = 8
ROWS_PER_TASK = 100_000


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Bucketed:
    """A table in the shared folder whose rows lie in hash buckets of ``keys``. ``add`` appends a file to each
    bucket that gets rows; the files of a bucket are read together."""

    def __init__(self, spark: SparkSession, keys: list[str]):
        self.spark, self.keys = spark, keys
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"pageflow_state_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{self.name}"
        self.additions = 0

    def _write(self, df: DataFrame) -> None:
        df.write.mode("append").bucketBy(self.buckets, *self.keys).option("path", self.path).saveAsTable(self.name)
        self.additions += 1

    def add(self, df: DataFrame, rows: int | None = None) -> Bucketed:
        """Appends ``df``; with ``rows``, its number of rows, by as few tasks as they need. The number of tasks divides
        that of the buckets, so that a bucket's rows are in one task and become one file."""
        wanted = self.buckets if rows is None else min(self.buckets, max(1, -(-rows // ROWS_PER_TASK)))
        tasks = next(n for n in range(wanted, self.buckets + 1) if self.buckets % n == 0)
        self._write(df.repartition(tasks, *self.keys))
        return self

    def take_all(self, other: Bucketed) -> None:
        """Appends another table with the same buckets, each bucket by a task of its own."""
        with _setting(self.spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
            self._write(other.rows())

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self, files: bool = False) -> None:
        """Drops the name; the files stay with the other checkpoints unless ``files`` is set."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if files:
            fs, path = file_system(self.spark, self.path)
            fs.delete(path, True)


class Growing:
    """A table that grows by additions and is asked which rows it lacks."""

    def __init__(self, spark: SparkSession, keys: list[str], fan: int = FAN):
        self.spark, self.keys, self.fan = spark, keys, fan
        self.tiers: list[Bucketed] = []

    def add(self, df: DataFrame, rows: int | None = None) -> None:
        if not self.tiers:
            self.tiers.append(Bucketed(self.spark, self.keys))
        self.tiers[0].add(df, rows)
        for k, tier in enumerate(self.tiers):
            if tier.additions < self.fan:
                break
            if k + 1 == len(self.tiers):
                self.tiers.append(Bucketed(self.spark, self.keys))
            self.tiers[k + 1].take_all(tier)
            self.tiers[k] = Bucketed(self.spark, self.keys)
            tier.forget(files=True)

    def tables(self) -> list[DataFrame]:
        return [t.rows() for t in self.tiers if t.additions]

    def lacking(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose keys aren't in the table; only ``df`` is shuffled, once."""
        return lacking(df, self.tables(), self.keys)

    def forget(self) -> None:
        for t in self.tiers:
            t.forget()


def lacking(df: DataFrame, tables: list[DataFrame], keys: list[str]) -> DataFrame:
    for t in tables:
        df = df.join(t.select(*keys), keys, "left_anti")
    return df
