import random
import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from pageflow.llm import minhash, phrase_index
from pageflow.llm.common import written


def shingle_sets(rows, n):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def components(rows, n, percent=80):
    """Smallest reachable id by comparing each two documents that share a shingle."""
    sets = shingle_sets(rows, n)
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    near = {i: set() for i in sets}
    for i, s in sets.items():
        for j in {j for g in s for j in by[g] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                near[i].add(j)
                near[j].add(i)
    root = {}
    for i in sorted(near):
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in root:
                    root[j] = i
                    todo += near[j]
    return root, sets


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_all_pairs(spark, sf_dir, words):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root, sets = components([tuple(r) for r in docs.select("doc_id", "text").collect()], words)
    for r in minhash.near_duplicates(docs, words).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])


def test_links_that_no_star_finds(spark):
    """Chains of edits in one hot bucket: hubs are unlike most members, which link among themselves."""
    import random

    rng = random.Random(11)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for k in range(160):
        w = list(base)
        for p in rng.sample(range(200), rng.choice([3, 6, 9, 12, 15])):
            w[p] = f"e{rng.randrange(30)}"
        rows.append((k, " ".join(w)))
    root, _ = components(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert len(set(root.values())) > 1 and got == root


def test_near_duplicates_of_odd_rows(odd, spark):
    rows = minhash.near_duplicates(odd, 2).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    root, sets = components([(i, t) for i, t in odd.select("doc_id", "text").collect() if i is not None], 2)
    for i, r in by.items():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), root[i])
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    kept = minhash.keep_first(odd, 2)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and sorted(i for i in ids if i is not None) == sorted(set(root.values())) and ids.count(None) == 2
    assert minhash.near_duplicates(odd.limit(0), 2).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(docs, items, n=13):
    """(n_words, n_hit, item ids) by sliding every window over every document."""
    windows = defaultdict(set)
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, of = words_of(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    of |= windows[tuple(w[k : k + size])]
        out.append((i, len(w), len(hit), len(of)))
    return out


ITEMS = [(1, "one two three"), (2, "a b"), (3, None), (4, ""), (None, "x y z"), (5, " ".join(f"q{k}" for k in range(30))), (5, "word"), (6, "One, TWO three!"), (7, "é ß 漢字")]


def test_contamination_of_odd_rows(odd, spark):
    items = spark.createDataFrame([(*x, 1, "w") for x in ITEMS], "item_id long, text string, n int, block string")
    rows = [(i, t) for i, t in odd.select("doc_id", "text").collect()] + [(100, "x " + " ".join(f"Q{k}" for k in range(5, 19)) + " y one, two\nThree one"), (101, " ".join(f"q{k}" for k in range(12)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda x: (x[0] is None, x)
    for part in (1 << 25, 64):  # at once, and in many parts
        got = phrase_index.contamination(docs, items, part_bytes=part).collect()
        want = plain_hits(rows, [x for x in ITEMS if x[0] is not None])
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got), key=str) == sorted(want, key=str)
        assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)
    del order
    assert phrase_index.contamination(docs.limit(0), items).count() == 0
    assert phrase_index.contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def plain_near(rows, items, window, span):
    """(doc, number of items of which a window's words stand in a stretch of ``span`` words)."""
    cut = {(i, frozenset(w[k : k + window]), min(len(w), window)) for i, t in items if i is not None and (w := words_of(t)) for k in range(max(1, len(w) - window + 1))}
    out = []
    for i, t in rows:
        w = words_of(t)
        wide = {k: [set(w[a : a + max(span, k)]) for a in range(len(w))] for k in {k for _, _, k in cut}}
        out.append((i, len({j for j, s, k in cut if any(s <= x for x in wide[k])})))
    return out


def test_near_items_against_all_stretches(odd, spark):
    draw = random.Random(3)
    text = lambda n, kinds: " ".join(draw.choice("abcdefghijklmnopqrst"[:kinds]) for _ in range(n))
    rows = [(k, text(draw.choice((0, 3, 7, 30, 200)), 20)) for k in range(60)] + [(60, "a " * 900), (61, None)]
    items = [(k, text(draw.choice((0, 1, 2, 4, 5, 9)), draw.choice((2, 20)))) for k in range(40)] + [(40, "a a a a"), (40, "a a a a"), (None, "b")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window, span, part in ((4, 6, 1 << 22), (4, 4, 128), (3, 9, 100)):
        got = phrase_index.contamination(docs, bench, window=window, span=span, part_bytes=part).collect()
        assert sorted((r["doc_id"], r["n_near"]) for r in got) == sorted(plain_near(rows, items, window, span))
        assert all(r["n_near"] >= r["n_items"] for r in got)
        plain = plain_hits(rows, [x for x in items if x[0] is not None], window)
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got) == sorted(plain)
    some = [x[:2] for x in ITEMS]
    got = phrase_index.contamination(odd, spark.createDataFrame(some, "item_id long, text string")).collect()
    want = plain_near([(i, t) for i, t in odd.select("doc_id", "text").collect()], some, 13, 20)
    assert sorted(((r["doc_id"], r["n_near"]) for r in got), key=str) == sorted(want, key=str)


def test_windows_by_either_way(spark, monkeypatch):
    """Tasks that can't open the folder get the part sent along; candidates come in pieces."""
    docs = spark.createDataFrame([(k, f"x one two three four y{k}") for k in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five"), (2, "two one")], "item_id long, text string")
    columns = ("doc_id", "n_hit", "n_items", "n_near")
    at_once = sorted(phrase_index.contamination(docs, bench, window=4).select(*columns).collect())
    assert at_once[0] == (0, 4, 1, 2)
    monkeypatch.setattr(phrase_index, "_opens", lambda path: False)
    monkeypatch.setattr(phrase_index, "TESTED", 3)
    assert sorted(phrase_index.contamination(docs, bench, window=4).select(*columns).collect()) == at_once


def test_index_blocks_are_read_one_by_one(spark, tmp_path, monkeypatch):
    """Blocks take megabytes: tasks get them in Arrow batches of a few MB, from row groups of a few, with a page to a block."""
    from pyspark import cloudpickle

    import pageflow

    cloudpickle.register_pickle_by_value(pageflow)  # so that tasks see what is patched here
    plain, seen = phrase_index._rows, f"{tmp_path}/seen"

    def rows(batches):
        for batch in batches:
            with open(seen, "a") as out:
                out.write(f"{batch.num_rows} {batch.nbytes}\n")
            yield from plain([batch])

    monkeypatch.setattr(phrase_index, "_rows", rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 200000), k -> concat('w', cast(pmod(hash(id * 7 + k), 3000) AS string))), ' ') AS text")
    index = phrase_index.build_index(texts)
    items = spark.createDataFrame([(1, "w1 w2 w3"), (2, texts.first()["text"][:200])], "item_id long, text string")
    hits = phrase_index.benchmark_hits(index, items, 13, 20).collect()
    assert 2 in {i for r in hits for i in r["items"]}
    batches = [tuple(map(int, x.split())) for x in open(seen)]
    assert sum(n for n, _ in batches) == index.count() == 10
    assert max(size for _, size in batches) < 1.5e7
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert max(m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups)) < 3e7
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_words_of_slices(monkeypatch):
    raw = "One, two\tthree ".encode() * 50 + b"x" * 40 + " é漢 y".encode()
    for size in (1, 7, 1 << 22):
        monkeypatch.setattr(phrase_index, "SLICE", size)
        assert [w for ws in phrase_index.alnum_slices(raw) for w in ws] == phrase_index.alnum_words(raw)
        assert [w for ws in phrase_index.alnum_slices(b"") for w in ws] == []


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red a b green c blue"), (2, "red x x x x x x green blue"), (3, "blue green"), (4, "Green red. blue red")], "doc_id long, text string")
    index = phrase_index.build_index(docs, block_words=8)
    near = lambda terms, k: sorted((r["doc_id"], r["place"]) for r in phrase_index.proximity_matches(index, terms, k).collect())
    assert {d for d, _ in near(["red", "green"], 3)} == {1, 4}
    assert {d for d, _ in near(["red", "green", "blue"], 2)} == {4}
    assert near(["absent", "red"], 9) == []


def test_pipeline_against_its_operators(spark, sf_dir):
    """Stage by stage against plain versions of the decisions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    now, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, now, sf_dir), name)
        if name != "best_fit_packing":
            assert after.columns == columns
        rows, kept = {r["doc_id"]: r for r in now.collect()}, {r["doc_id"] for r in after.collect()}
        if name == "minhash_near_dedup":
            root, _ = components([(i, r["text"]) for i, r in rows.items()], 5)
            assert kept == set(root.values())
        if name == "benchmark_decontamination":
            hits = plain_hits([(i, r["text"]) for i, r in rows.items()], [tuple(r) for r in bench.select("item_id", "text").collect()])
            assert kept == {i for i, n, h, _ in hits if not (h and 20 * h >= n)}
        if name == "pii":
            assert kept == set(rows)
            assert all(len(r["text"]) == r["n_chars"] and not re.search(r"[a-z0-9]@[a-z0-9]+\.example", r["text"]) for r in after.collect())
        now = after
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.count() == now.count() and sorted(whole.columns) == sorted(now.columns)


def test_pipeline_on_odd_rows(odd, spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() >= 0
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
