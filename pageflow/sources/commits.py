"""Numbered commits in a shared folder: what makes state written by Spark jobs visible, whole or not at all.

A commit is a small JSON document, written beside its place and then renamed, so a driver that is lost while
it writes leaves nothing that a reader takes for a commit. Data files are written first, under names of their own;
those of a lost attempt are never referred to. One driver writes at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, folder: str):
    """(file system, path) of a folder, through the Hadoop client that Spark itself uses."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs, self.path = file_system(spark, self.folder)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.path):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def last(self) -> int | None:
        return max(self.numbers(), default=None)

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/{number:012d}.json", wholetext=True).first()[0])

    def commit(self, number: int, content: dict) -> None:
        """Makes ``content`` commit ``number``; an error if there is one already."""
        beside, place = self._at(f".{uuid.uuid4().hex}"), self._at(f"{number:012d}.json")
        out = self.fs.create(beside, False)
        out.write(json.dumps(content, sort_keys=True).encode())
        out.close()
        if self.fs.exists(place) or not self.fs.rename(beside, place):
            raise RuntimeError(f"commit {number} is there already in {self.folder}")
