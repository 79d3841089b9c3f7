import hashlib
import re

from pageflow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def same(rows):
    for text, r in rows:
        want = plain(text)
        for k in PATTERNS:
            assert r[f"n_{k}"] == sum(x[2] == k for x in want), (text, k)
        listed = [f"{k}:{s}:{e}" for s, _, k, e in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest(), text
        got = [x for x in r["spans"].split(",") if x.split(":")[0] in PATTERNS]
        assert got == listed
        starts = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) for x in r["spans"].split(",") if x]
        assert starts == sorted(starts)


def test_odd_texts(odd):
    got = pii.report(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    same([(t, by[i]) for i, t in odd.select("doc_id", "text").collect() if i is not None])


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = {r["doc_id"]: r for r in pii.report(docs).collect()}
    rows = [(r["text"], by[r["doc_id"]]) for r in docs.collect()]
    same(rows)
    extra = [x for _, r in rows for x in r["spans"].split(",") if x and x.split(":")[0] not in PATTERNS]
    assert extra, "the trees add spans"


def test_no_python_in_plan(spark, odd):
    plan = pii.report(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(none).count() == 0
    assert pii.redact(none).count() == 0


def test_redaction(odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    before = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    for i, t in before.items():
        if not plain(t):
            continue
        assert not [x for x in plain(texts[i]) if t[x[0] : x[3]] == texts[i][x[0] : x[3]] and x in plain(t)]
    assert texts[18] == "🙂 mail [EMAIL], [IP];"
    assert texts[0] is None and texts[1] == ""


def test_luhn_and_score_sql(spark):
    """The SQL of the trees gives what the arrays give."""
    import numpy as np
    from pyspark.sql import functions as F

    from pageflow.llm.boosting import fit

    rng = np.random.default_rng(1)
    bins = rng.integers(0, 8, (300, len(pii.FEATURES)))
    trees = fit(bins, (bins[:, 1] + bins[:, 3] > 7).astype(int), np.ones(300), trees=5, depth=3)
    df = spark.createDataFrame([tuple(map(int, r)) for r in bins], [f"f_{k}" for k in pii.FEATURES])
    got = [r[0] for r in df.select(F.expr(pii.score_sql(trees))).collect()]
    assert np.allclose(got, trees.raw(bins))
    assert ((trees.raw(bins) > 0) == (bins[:, 1] + bins[:, 3] > 7)).mean() > 0.8


def test_rare_secrets_beside_many_frequent_numbers(spark):
    """More distinct feature rows than the sample holds: every generator is fitted, and all held-out rows calibrate."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(8)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = []
    for _ in range(300):
        number = "-".join(digits(rng.randint(1, 9)) for _ in range(rng.randint(3, 8)))
        rows += [f"{rng.choice(['call', 'sum', 'id'])} {digits(rng.randint(7, 28))} and {number};"] * 3
    for _ in range(400):
        rows.append(f"password={''.join(rng.choices('0123456789abcdef', k=rng.randint(18, 60)))} end")
        rows.append(f"see {'-'.join(''.join(rng.choices('abcdefghij', k=rng.randint(3, 8))) for _ in range(5))}-{digits(1)} there")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = pii.candidates(docs)
    loose = pii.features(found.filter(F.col("gen").isin(*pii.LOOSE)))
    assert loose.select(*[f"f_{k}" for k in pii.FEATURES], "label").distinct().count() > 300
    trees, limits = pii.train(loose, patterns=120)
    names = [f"f_{k}" for k in pii.FEATURES]
    held = sum(((k + 3) * F.col(c) for k, c in enumerate(names)), F.lit(0)) % 4 == 0
    scored = loose.filter(held).select("f_gen", "label", F.expr(pii.score_sql(trees)).alias("score")).collect()
    for g, limit in limits.items():
        of = [r["label"] for r in scored if r["f_gen"] == g and r["score"] >= limit - 1e-9]
        assert not of or sum(of) >= 0.97 * len(of), g
    secrets = pii.spans(docs, patterns=120).filter("kind = 'secret'").select("doc_id").distinct().count()
    assert secrets > 100  # 40 rows of secrets give coarse trees, but secrets do not vanish


def test_redaction_beside_any_column_names(spark):
    rows = [(1, "write to a.b@c.org now", "x", [1], 7, "k"), (2, None, "y", None, None, None), (1, "write to a.b@c.org now", "z", [2], 8, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _runs string, _key array<int>, _hash long, runs string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, t and "write to [EMAIL] now", *r) for i, t, *r in rows), key=str)
