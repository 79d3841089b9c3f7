"""Skew-proof per-group ranking.

``row_number() over (partition by g order by o)`` sends a whole group to one task; when
one host or one name holds a third of all rows that task does a third of the job. Here
the rows are range-partitioned on ``(g, o)`` (the sampler splits a hot group over many
partitions), written once, numbered or summed inside each (partition, group) piece, and the
per-piece totals - a table of at most #partitions rows per group - give each piece its
offset. There is one path for every input size, in DataFrame operations alone, and NULL is a group
like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _range_split(df: DataFrame, cols: list[str]) -> DataFrame:
    """Range-partition on ``cols``, sort inside, tag rows with partition id, and write the
    result once (reliable checkpoint).

    The write matters: Spark's range partitioner seeds its sample with the RDD id, so two
    executions of the same range shuffle may cut different bounds. Offsets and rows must
    come from one materialized copy.
    """
    from pageflow.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *[F.col(c) for c in cols]).sortWithinPartitions(*cols)
    tagged = ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    return tagged.checkpoint(eager=True)


def _with_offsets(rows: DataFrame, tagged: DataFrame, group_cols: list[str], total, *extra) -> DataFrame:
    """``rows`` (of ``tagged``) with ``_off``: the totals of the group's earlier pieces."""
    pieces = tagged.groupBy("_pid", *group_cols).agg(total.alias("_n"), *extra)
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    t, p = rows.alias("t"), pieces.alias("p")
    cond = [F.col("t._pid") == F.col("p._pid")] + [F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}")) for c in group_cols]
    kept = [F.col(f"p.{c}") for c in pieces.columns if c not in ("_pid", *group_cols)]
    return t.join(p, cond, "inner").select("t.*", *kept)


def _ranked(tagged: DataFrame, group_cols: list[str], name: str) -> DataFrame:
    out = _with_offsets(tagged, tagged, group_cols, F.count("*"), F.min("_mid").alias("_first"))
    return out.withColumn(name, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1).drop("_first", "_off")


def _summed(tagged: DataFrame, group_cols: list[str], value: Column, name: str) -> DataFrame:
    piece = Window.partitionBy("_pid", *group_cols).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_local", F.coalesce(F.sum(value).over(piece), F.lit(0)))
    out = _with_offsets(local, tagged, group_cols, F.sum(value))
    return out.withColumn(name, (F.col("_off") + F.col("_local")).cast("long")).drop("_local", "_off")


def rank_in_groups(df: DataFrame, group_cols: list[str], order_cols: list[str], name: str = "rn") -> DataFrame:
    """Adds ``name`` = 1-based row number of each row inside its group, by ``order_cols``.

    ``order_cols`` should make the order total (end with a unique id) so that a
    recomputed partition numbers its rows the same way.
    """
    return _ranked(_range_split(df, group_cols + order_cols), group_cols, name).drop("_pid", "_mid")


def running_sum_in_groups(df: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str, name: str) -> DataFrame:
    """Adds ``name`` = exclusive running sum of ``value_col`` inside each group, by ``order_cols``."""
    value = F.coalesce(F.col(value_col), F.lit(0)).cast("long")
    return _summed(_range_split(df, group_cols + order_cols), group_cols, value, name).drop("_pid", "_mid")


def rank_and_sum_in_groups(df: DataFrame, group_cols: list[str], order_cols: list[str], rank: str, value: Column, total: str) -> DataFrame:
    """Adds ``rank`` (1-based) and ``total``, the exclusive running sum of ``value``, which may use the rank: both from one
    range sort that is written once."""
    tagged = _ranked(_range_split(df, group_cols + order_cols), group_cols, rank)
    return _summed(tagged, group_cols, F.coalesce(value, F.lit(0)).cast("long"), total).drop("_pid", "_mid")
