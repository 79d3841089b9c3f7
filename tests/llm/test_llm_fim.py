import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pageflow.llm import fim

SETTINGS = fim.Settings()


def plain(key, text, settings=SETTINGS):
    """The contract, on strings."""
    text, n = text or "", len(text or "")
    h = hashlib.sha256(f"{settings.seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    p, m, s = settings.prefix, settings.middle, settings.suffix
    if not text or p in text or m in text or s in text or h3 % 100 >= settings.plain_from:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < settings.spm_below:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


def run(spark, rows, settings=None):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, output string")
    made = fim.transformed(docs, settings=settings)
    return made.withColumn("back", fim.restored(settings=settings)).withColumn("digest", fim.restored_digest(settings=settings)).collect()


def check(rows, got, settings=SETTINGS):
    key = lambda x: tuple((v is None, v) for v in x)
    want = sorted(((i, *plain(i, t, settings), t or "") for i, t in rows), key=key)
    have = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], bytes(r["output"]).decode(), bytes(r["back"]["text"]).decode()) for r in got), key=key)
    assert have == want
    for r in got:
        assert r["output_sha256"] == hashlib.sha256(r["output"]).hexdigest()
        assert r["digest"] == r["back"]["sha256"] == hashlib.sha256(r["back"]["text"]).hexdigest()
        assert sum(p["length"] for p in r["pieces"]) == len(r["output"])


def test_odd_rows(odd, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    check(rows, run(spark, rows))


def test_random_texts_and_sentinel_crumbs(spark):
    rng = random.Random(5)
    pool = ["<", ">", "P", "S", "M", "<P", "S>", "é", "漢", "🙂", "a", " "]
    rows = [(k, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for k in range(2000)]
    rows += [(5000 + k, mark) for k, mark in enumerate(("<P>", "x<S>", "<M>y", "<P><S><M>", "<p>", "<<P", "<S<M"))]
    got = run(spark, rows)
    check(rows, got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_very_long_texts(spark):
    rows = [(k, t) for k, t in enumerate(["a" * 3_000_000, "é" * 1_500_000 + "🙂" * 400_000, "x漢" * 700_000, "é" * (1 << 19) + "z"] * 3)]
    check(rows, run(spark, rows))


def test_bytes_that_are_not_utf8(spark):
    raws = [b"\xff\xfe\x80abc", b"\x80\x80\x80", b"ok \xe9t\xe9 \xc3", b"\xf0\x9f\x99"] * 5
    docs = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(raws)], "doc_id long, raw binary").withColumn("text", F.col("raw").cast("string"))
    made = fim.transformed(docs).withColumn("back", fim.restored()["text"])
    for r in made.collect():
        raw = raws[r["doc_id"]]
        assert bytes(r["back"]) == raw and r["n"] == sum(b & 0xC0 != 0x80 for b in raw)


def test_other_settings(spark):
    rows = [(k, f"def f{k}(): return <mid> {k}") for k in range(200)]
    s = fim.Settings(seed=7, plain_from=50, spm_below=100, prefix="<pre>", middle="<mid/>", suffix="[suf]")
    got = run(spark, rows, s)
    check(rows, got, s)
    assert {r["form"] for r in got} == {"plain", "spm"}
    for marks in (("ab", "ba", "x"), ("a", "aa", "x"), ("", "b", "c"), ("<P>", "<P>", "<S>"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            fim.Settings(prefix=marks[0], middle=marks[1], suffix=marks[2])


def test_table_operations():
    held = fim.PieceTable(b"hello world", b"<>")
    held.cut(5)
    held.cut(6)
    held.add_marks([1, 1])
    order = (3, 2, 4, 0, 1)
    held.permute(order)
    assert held.text() == b"<world>hello "
    held.permute(fim.inverse(order))
    assert held.text() == b"hello world<>"
    assert fim.PieceTable(b"").text() == b""
    with pytest.raises(ValueError):
        fim.PieceTable(b"ab").cut(3)


def test_empty_table(odd):
    assert fim.transformed(odd.limit(0)).withColumn("d", fim.restored_digest()).count() == 0
