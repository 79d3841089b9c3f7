"""Connected components by alternating star contractions.

Each round hangs the neighbours of a node on the least id in its neighbourhood: first the larger
neighbours (large star), then the smaller ones (small star). Both keep the components, and the graph
becomes one star per component after O(log^2 n) rounds, few in practice. A round is two grouped
minima (combined before the shuffle) and two joins that deal a hot node's edges over several tasks; the
edges never outgrow the input. Every round is cut with a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.llm.common import checkpointed
from pageflow.operators.skew import salted_join


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def star_components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of ids -> (u, root): each id that isn't the least of its component, with the least."""
    edges = checkpointed(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )
    before = _mark(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = salted_join(large, least, ["u"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select("u", F.col("v").alias("root"))
