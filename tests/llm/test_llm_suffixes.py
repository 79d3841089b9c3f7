import random
import re
from collections import defaultdict

import numpy as np

from pageflow.llm import suffixes


def covered(rows, least=51):
    """Words of each document that lie in a run of ``least`` words that another document has too."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, []).append(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))
    where = defaultdict(set)
    for i, many in texts.items():
        for w in many:
            for k in range(len(w) - least + 1):
                where[tuple(w[k : k + least])].add(i)
    out = {}
    for i, many in texts.items():
        hit = set()
        for w in many:
            for k in range(len(w) - least + 1):
                if len(where[tuple(w[k : k + least])]) > 1:
                    hit.update(range(k, k + least))
        if hit:
            out[i] = hit
    return out


def found(df):
    out = defaultdict(set)
    for r in df.collect():
        assert r["other"] != r["doc_id"] and r["n_words"] == r["stop"] - r["start"] >= 51
        span = set(range(r["start"], r["stop"]))
        assert not out[r["doc_id"]] & span
        out[r["doc_id"]] |= span
    return dict(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, seed int, behind binary")


def test_odd_texts(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert found(suffixes.repeated_passages(odd)) == covered(rows)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(suffixes.query(spark, sf_dir)) == covered(rows)


def test_planted_passages_of_exact_lengths(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(4000)]
    some = lambda n: rng.choices(words, k=n)
    rows, caught, clean = [], set(), set()
    for k in range(120):
        n = (50, 51, 52, 60, 300)[k % 5]
        passage = some(n)
        for j in range(2):
            rows.append((10 * k + j, " ".join(some(rng.randint(0, 80)) + ["x" * (j + 3)] + passage + ["y" * (j + 3)] + some(rng.randint(0, 80)))))
            (caught if n > 50 else clean).add(10 * k + j)
    hot = " ".join(some(70))
    for k in range(2000, 2400):
        rows.append((k, f"{' '.join(some(20))} {hot.upper() if k % 2 else hot} {' '.join(some(20))}"))
        caught.add(k)
    rows += [(3000, "  \n".join(some(60))), (3001, None), (3002, " ".join(["same"] * 500)), (3003, " ".join(some(30) * 4))]
    rows += [(3004, rows[-4][1])] * 3
    got = found(suffixes.repeated_passages(frame(spark, rows)))
    assert got == covered(rows)
    assert caught <= set(got) and not clean & set(got) and {3000, 3004} <= set(got) and not {3002, 3003} & set(got)


def test_minimisers_against_plain_search():
    rng = np.random.default_rng(3)
    for n in (0, 10, 33, 34, 35, 200):
        words = rng.integers(0, 50, n).astype(np.uint64)
        grams = suffixes.gram_hashes(words, 5)
        want = {k + min(range(30), key=lambda j, k=k: (grams[k + j], j)) for k in range(max(0, n - 33))} if n >= 34 else set()
        assert set(suffixes.minimisers(words, 5, 30).tolist()) == want


def test_empty_table(spark):
    assert suffixes.repeated_passages(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_cores_that_need_words_on_both_sides(spark):
    """A passage of 51 words is a core and one of 10 heads or tails: partners are adjacent in no sort order."""
    rng = random.Random(5)
    some = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    core, heads, tails = some(45), [some(4) for _ in range(10)], [some(4) for _ in range(10)]
    rows = [(k, " ".join(some(30) + rng.choice(heads) + core + rng.choice(tails) + some(30))) for k in range(600)]
    want = covered(rows)
    assert len(want) > 590 and found(suffixes.repeated_passages(frame(spark, rows))) == want


def test_passage_twice_in_the_least_document(spark):
    rng = random.Random(6)
    some = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = some(200)
    rows = [(5, " ".join(some(40) + passage + some(40) + passage + some(40))), (9, " ".join(some(25) + passage + some(25)))]
    rows += [(k, " ".join(some(100))) for k in range(20, 60)]
    want = covered(rows)
    assert len(want[5]) == 400 and found(suffixes.repeated_passages(frame(spark, rows))) == want


def test_suffix_order_alone_finds_passages_of_two_documents(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for k in range(80):
        passage = rng.choices(words, k=(50, 51, 53, 79, 80, 400)[k % 6])
        for j in range(2):
            text = [*rng.choices(words, k=rng.randint(0, 60)), "x" * (j + 3), *passage, "y" * (j + 3), *rng.choices(words, k=rng.randint(0, 60))]
            rows.append((10 * k + j, " ".join(text)))
    seen = {}

    def keep(suffixes_, least, window):
        seen["rows"], seen["spans"] = suffixes_.count(), real(suffixes_, least, window).collect()
        return real(suffixes_, least, window)

    real = suffixes.neighbours
    monkeypatch.setattr(suffixes, "neighbours", keep)
    got = found(suffixes.repeated_passages(frame(spark, rows)))
    spans = defaultdict(set)
    for r in seen["spans"]:
        spans[r["doc_id"]].update(range(r["start"], r["stop"]))
    # a row at the start or end of a partition may lack one neighbour, the other side finds it
    want = covered(rows)
    assert got == want and seen["rows"] >= len(want)
    assert sum(len(want[i] & spans[i]) for i in want) >= 0.9 * sum(map(len, want.values())) and all(spans[i] <= want[i] for i in spans)


def test_scan_against_plain_neighbours():
    import pyarrow as pa

    rng = random.Random(3)
    least, window, reach = 51, 30, 29
    texts = {d: [rng.choice("ab") for _ in range(reach)] + ["s"] * 22 + [rng.choice("ab") for _ in range(rng.choice((12, 20, 29)))] for d in range(300)}
    rows = []
    for d, t in texts.items():
        behind, before = t[reach + 22 :], t[:reach][::-1]
        pad = lambda ws: np.array([ord(w) for w in ws] + [0] * (reach - len(ws)), "<u4").tobytes()
        rows.append((5 + d % 2, d // 2, reach, len(behind), len(before), pad(behind), pad(before)))
    rows.sort(key=lambda r: (r[0], r[5], r[6], r[1], r[2]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names=list("abcdefg"))
    common = lambda a, b, most: next((k for k in range(most) if a[4 * k : 4 * k + 4] != b[4 * k : 4 * k + 4]), most)
    want = set()
    for k, r in enumerate(rows):
        for side in (rows[:k][::-1], rows[k + 1 :]):
            o = next((x for x in side if x[1] != r[1]), None)
            if o and o[0] == r[0]:
                right, left = common(r[5], o[5], min(r[3], o[3])), common(r[6], o[6], min(r[4], o[4]))
                if left + 22 + right >= least:
                    want.add((r[1], reach - left, reach + 22 + right, o[1]))
    for cuts in ([0, 300], [0, 1, 2, 100, 300]):
        out = suffixes._scan((batch(rows[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)), least, window)
        assert {tuple(r.values()) for x in out for r in x.to_pylist()} == want
    assert list(suffixes._scan(iter([batch(rows[:5]).slice(0, 0)]), least, window)) == []
