import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pageflow.llm import sharding


def laws(rows, texts, n=8):
    """Counts at most one apart, slots gapless, sizes and digests right."""
    count = Counter(r["shard"] for r in rows)
    assert set(count) <= set(range(n)) and max(count.values(), default=0) - min((count.get(k, 0) for k in range(n)), default=0) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_odd_texts(odd):
    laws(sharding.sharded(odd).collect(), odd.select("doc_id", "text").collect())


def test_documents_and_groups(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = sharding.query(spark, sf_dir).collect()
    laws(rows, texts)
    of = dict(texts)
    where = defaultdict(list)
    for r in rows:
        where[of[r["doc_id"]]].append(r["shard"])
    groups = [g for g in where.values() if len(g) > 1]
    assert sum(len(set(g)) == 1 for g in groups) > 0.95 * len(groups)


def test_hot_group(spark):
    rng = random.Random(4)
    rows = [(k, "hot" if k % 3 == 0 else f"t{k % 70}" if k % 3 == 1 else f"own {rng.random()}") for k in range(3000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    laws(got, rows)
    of = dict(rows)
    hot = Counter(r["shard"] for r in got if of[r["doc_id"]] == "hot")
    assert sum(x for _, x in hot.most_common(4)) > 900  # 1000 rows need three shards of 375
    cut = defaultdict(Counter)
    for r in got:
        cut[of[r["doc_id"]]][r["shard"]] += 1
    small = [c for t, c in cut.items() if t.startswith("t")]
    assert sum(max(c.values()) for c in small) > 0.8 * sum(sum(c.values()) for c in small)


def test_general_links_cut_fewer_edges_than_chance(spark):
    """Two-level communities: most links inside, some across."""
    rng = random.Random(9)
    edges = [(a, b) for a, b in ((rng.randrange(800), 0) for _ in range(6000))]
    edges = [(a, (a // 20) * 20 + rng.randrange(20) if rng.random() < 0.9 else rng.randrange(800)) for a, _ in edges]
    e = spark.createDataFrame([x for x in edges if x[0] != x[1]], "u long, v long")
    label = {r["node"]: r["shard"] for r in sharding.propagate(e, [210] * 4, rounds=12).collect()}
    assert max(Counter(label.values()).values()) <= 240
    inside = sum(label[a] == label[b] for a, b in edges if a != b) / len(edges)
    assert inside > 0.4  # by chance a quarter


def test_quota():
    share = sharding._quota({(0, 1): 10, (1, 0): 4, (2, 1): 6}, [5, 9, 6], [10, 12, 10])
    assert share[1, 0] == 1.0 and abs(10 * share[0, 1] + 6 * share[2, 1] - 4 - 3) < 1e-9


def test_empty_table(spark):
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_is_distributed(odd):
    nodes = sharding.text_nodes(odd)
    assert "CartesianProduct" not in sharding.equal_text_edges(nodes, 100)._jdf.queryExecution().toString()
    assert nodes.select(F.count_distinct("node")).first()[0] == odd.count()
