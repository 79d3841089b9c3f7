"""Sharding by balanced label propagation (operator 7).

Linked rows should share a shard, shards should have equal counts. Rows that have links start spread by
hash, those with very many links each where most room is left. In each round every linked row looks at its neighbours' shards (a join of edges and labels, counted
per row and shard) and wants the one that most of them are in; half of the rows, another half
each time, may move, so that neighbours don't just swap. Quotas keep the sizes: per pair of shards, as many
moves are accepted as go both ways, and beyond that only what fits under a shard's share of all rows. What
goes to the driver is the table of moves between shards, n x n numbers, and the few rows with very many links.

Rows without links fill up the shards at the end, where a shard's rows are numbered, linked ones first:
those beyond the exact share move to the shards that miss some. So counts differ by one at most (law
``rows``), every slot is numbered without gaps, and only groups that meet a quota are cut.

The numbering splits hot shards over tasks; edges are stars, so a group of n rows has n - 1 of them, and
the joins' hot side can be split by adaptive execution. Null texts count as empty (size 1, CRC 0) and equal each
other. Repeated rows and null ids are rows of their own. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm.common import checkpointed, table, written
from pageflow.operators.ranking import rank_in_groups
from pageflow.operators.skew import salted_join

SHARDS, ROUNDS = 8, 12


def text_nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, doc_id, size, text_crc32, text_key) of each row, written once."""
    t = F.coalesce(F.col(text), F.lit(""))
    return written(docs.select(
        F.monotonically_increasing_id().alias("node"), F.col(key).alias("doc_id"), (F.octet_length(t) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(t, "utf-8")).alias("text_crc32"), F.unhex(F.md5(t)).alias("text_key"),
    ), "nodes")


def equal_text_edges(nodes: DataFrame, most: int) -> DataFrame:
    """(u, v): stars over groups of equal texts, each row with a hub. A group of more than ``most`` rows
    can't stay whole: it is dealt into as many equal stars as it needs, whose hubs are linked."""
    groups = nodes.groupBy("text_key").agg(F.count("*").alias("n")).filter("n > 1")
    groups = checkpointed(groups.select(F.col("text_key").alias("k"), F.ceil(F.col("n") / max(1, most)).alias("stars")))
    rows = nodes.select(F.col("text_key").alias("k"), "node")  # one text may have a third of all rows: dealt over several tasks
    dealt = salted_join(rows, groups, ["k"]).select("node", F.col("k").alias("text_key"), F.pmod(F.xxhash64("node"), F.col("stars")).alias("star"))
    hubs = checkpointed(dealt.groupBy("text_key", "star").agg(F.min("node").alias("v")))
    spokes = salted_join(dealt, hubs, ["text_key", "star"]).filter("node <> v").select(F.col("node").alias("u"), "v")
    first = hubs.groupBy("text_key").agg(F.min("v").alias("f")).withColumnRenamed("text_key", "k")
    return spokes.unionAll(hubs.join(first, (F.col("text_key") == F.col("k")) & (F.col("v") != F.col("f"))).select(F.col("v").alias("u"), F.col("f").alias("v")))


def _seeds(both: DataFrame, most: list[int]) -> dict[int, int]:
    """First shards of nodes whose links would take up a sixteenth of a shard, 32 per shard at most (stars
    have no more): the largest first, each where most room is left."""
    many = both.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") * 16 >= max(most))
    room, seeds = list(most), {}
    for r in many.orderBy(F.desc("n"), "u").limit(32 * len(most)).collect():
        seeds[r["u"]] = max(range(len(room)), key=lambda k: room[k])
        room[seeds[r["u"]]] -= r["n"] + 1
    return seeds


def _quota(wants: dict[tuple[int, int], int], size: list[int], most: list[int]) -> dict[tuple[int, int], float]:
    """For each (from, to) the share of its wanted moves that are accepted."""
    room = [max(0, m - s) for m, s in zip(most, size, strict=True)]
    share = {}
    rest = {}
    for (a, b), n in wants.items():
        swap = min(n, wants.get((b, a), 0))
        rest[a, b] = n - swap
        share[a, b] = swap
    for b in range(len(size)):
        more = {k: n for k, n in rest.items() if k[1] == b and n}
        total = sum(more.values())
        for k, n in more.items():
            share[k] += n * min(1.0, room[b] / total)
    return {k: v / wants[k] for k, v in share.items()}


def propagate(edges: DataFrame, most: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) of every node that has an edge; ``most`` nodes per shard."""
    n = len(most)
    both = checkpointed(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    start = F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    seeds = both.sparkSession.createDataFrame(list(_seeds(both, most).items()), "seed long, seeded int")
    nodes = both.select(F.col("u").alias("node")).distinct().join(F.broadcast(seeds), F.col("node") == F.col("seed"), "left")
    labels = checkpointed(nodes.select("node", F.coalesce("seeded", start).alias("shard")))
    chance = lambda r, what: F.pmod(F.xxhash64("node", F.lit(r), F.lit(what)), F.lit(1 << 20)) / float(1 << 20)
    still = 0
    for r in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("v"), "shard"), "v").groupBy("u", "shard").agg(F.count("*").alias("n"))
        best = votes.groupBy("u").agg(F.max(F.struct("n", (-F.col("shard")).alias("least"))).alias("b"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("all"))
        wish = labels.join(best, F.col("node") == F.col("u")).select("node", "shard", (-F.col("b.least")).alias("to"), F.col("b.n").alias("n"), F.coalesce(F.try_element_at("all", F.col("shard")), F.lit(0)).alias("own"))
        wish = checkpointed(wish.withColumn("moves", (F.col("n") > F.col("own")) & (chance(r, "turn") < 0.5)))
        wants = {(x["shard"], x["to"]): x["count"] for x in wish.filter("moves").groupBy("shard", "to").count().collect()}
        sizes = {x["shard"]: x["count"] for x in wish.groupBy("shard").count().collect()}
        share = _quota(wants, [sizes.get(k, 0) for k in range(n)], most)
        still = 0 if any(share.values()) else still + 1
        if still == 2:  # neither half has a move that fits
            break
        if still:
            continue
        accept = F.lit(0.0)
        for (a, b), x in share.items():
            accept = F.when((F.col("shard") == a) & (F.col("to") == b), F.lit(x)).otherwise(accept)
        moved = F.col("moves") & (chance(r, "quota") < accept)
        labels = checkpointed(wish.select("node", F.when(moved, F.col("to")).otherwise(F.col("shard")).cast("int").alias("shard")))
    return labels


def shards(nodes: DataFrame, edges: DataFrame, n: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``nodes`` with shard, slot: shards of equal counts that cut few edges."""
    total = nodes.count()
    most = [total // n + (k < total % n) for k in range(n)]
    labels = propagate(edges, most, rounds).select(F.col("node").alias("l"), F.col("shard").alias("known"))
    rows = nodes.join(labels, F.col("node") == F.col("l"), "left").drop("l")
    rows = rows.withColumn("shard", F.coalesce("known", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int"))).withColumn("alone", F.col("known").isNull().cast("int")).drop("known")
    ranked = checkpointed(rank_in_groups(rows, ["shard"], ["alone", "text_key", "node"], "rank"))
    have = {x["shard"]: x["count"] for x in ranked.groupBy("shard").count().collect()}
    have = [have.get(k, 0) for k in range(n)]
    at = F.col("rank") - 1
    over, miss, before, filled = F.lit(None).cast("bigint"), [], 0, 0
    for k in range(n):
        if have[k] > most[k]:
            over = F.when((F.col("shard") == k) & (at >= most[k]), at - most[k] + before).otherwise(over)
            before += have[k] - most[k]
    for k in range(n):
        if have[k] < most[k]:
            miss.append((k, filled, filled + most[k] - have[k]))
            filled = miss[-1][2]
    to, slot = F.col("shard"), at
    for k, a, b in miss:
        goes = (F.col("over") >= a) & (F.col("over") < b)
        to, slot = F.when(goes, F.lit(k)).otherwise(to), F.when(goes, F.col("over") - a + have[k]).otherwise(slot)
    return ranked.withColumn("over", over).select(*nodes.columns, to.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))


def sharded(docs: DataFrame, n: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard and slot, groups of equal texts kept together as far as the counts allow."""
    nodes = text_nodes(docs, key, text)
    out = shards(nodes, equal_text_edges(nodes, -(-nodes.count() // n)), n)
    return out.select(
        F.col("doc_id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
