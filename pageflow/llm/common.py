"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import pageflow
from pageflow.session import checkpoint_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(pageflow.__file__)))
if _ROOT not in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
    # Python workers elsewhere may not see the folder that the driver imported this package from,
    # so its functions travel with the tasks
    cloudpickle.register_pickle_by_value(pageflow)

#: What a word is in quality and duplicate operators: a run without ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; its lineage is cut there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, seen by the driver and all executors."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: columns that a reader leaves out are not read."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: For tables whose rows take megabytes: Parquet's writer looks at its sizes after every row (it waits for 100
#: otherwise), so that a page holds about one row and a row group a few, whatever a task writes.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(1 << 24)}


@contextmanager
def small_batches(spark: SparkSession, size: int = 1 << 22) -> Iterator[None]:
    """Python tasks that run meanwhile get Arrow batches that end with the row that takes them to ``size`` bytes.

    By default up to 64 MB go in one, which an executor holds outside its heap, and the memory of such large buffers
    comes back late or in pieces.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text) -> F.Column:
    """Lower-cases A-Z alone; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def utf8(text) -> F.Column:
    """Text as bytes for a Python task (null stays null), so that odd bytes can't break decoding."""
    return F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary")
