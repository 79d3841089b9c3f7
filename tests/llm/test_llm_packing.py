import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pageflow.llm import packing


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_tokenizers(plain):
    coder, rng = packing.Coder(packing.vocabulary()), random.Random(3)
    parts = ["a", "b ", " ", "\n", "\t", "1", "'s", " '", "é", "!", " ", "　", "\x1c", "\u0085", "\r", "<|endoftext|>", "🙂", "漢", "ﬀ", "½"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    texts += [f"a{chr(c)}1 {chr(c)}" for c in range(0x20, 0x110000, 37) if not 0xD800 <= c < 0xE000] + [" " * 5000, "x" * 9000]
    assert all(np.frombuffer(coder.ids(t), "<u4").tolist() == plain(t) for t in texts)


def test_any_text_gets_through(spark, plain):
    """Long runs, the special string and bytes that aren't UTF-8, against the plain call without switches."""
    coder = packing.Coder(packing.vocabulary())
    assert plain("a <|endoftext|> b") == [64, 220, 50256, 275]
    texts = [" " * 3_000_000, "\n \t" * 400_000 + "x", "x" + " " * 1_000_000 + "y z", "a" * 1_500_000, "é" * 300_000, "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|" + ">" * 3]
    assert all(np.frombuffer(coder.ids(t), "<u4").tolist() == plain(t) for t in texts)
    raws = [b"ok \xff\xfe", b"\xe9t\xe9", b"\xf0\x9f\x99", *[t.encode() for t in texts[:2]], texts[5].encode()]
    docs = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(raws)], "doc_id long, raw binary").withColumn("text", F.col("raw").cast("string"))
    got = {(r["doc_id"], r["piece"]): r for r in packing.packed_documents(docs).collect()}
    for k, raw in enumerate(raws):
        ids = plain(raw.decode("utf-8", "replace")) + [2]
        assert sum(r["length"] for (i, _), r in got.items() if i == k) == len(ids)
        assert got[k, 0]["ids_crc32"] == zlib.crc32(np.array(ids[: len(ids) % 1024 or 1024], "<u4").tobytes())


def check(docs, placed, plain):
    """Every piece of every row is placed once, sequences are gapless and never too long."""
    rows, want, lengths = placed.collect(), [], []
    for i, text in docs.select("doc_id", "text").collect():
        ids = plain(text) + [2]
        lengths.append(len(ids))
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    order = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted([tuple(r[:5]) for r in rows], key=order) == sorted(want, key=order)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    return len(bins), sum(lengths)


def test_odd_texts(odd, plain):
    check(odd, packing.packed_documents(odd), plain)


def test_documents(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, total = check(docs, packing.query(spark, sf_dir), plain)
    assert n <= 1.01 * total / 1024 + 1


def test_groups_lose_little(odd, spark, sf_dir):
    parts = packing.pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
    one = packing.pack(parts).select("sequence_id").distinct().count()
    many = packing.pack(parts, group_pieces=100).select("sequence_id").distinct().count()
    assert one <= many <= 1.05 * one + 10


def test_best_fit_against_plain_search():
    rng = random.Random(5)
    for _ in range(50):
        size = rng.choice([1, 7, 64, 1024])
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(0, 200))), reverse=True)
        rooms, want = [], []
        for n in lengths:
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                rooms.append(size - n)
            else:
                rooms[rooms.index(fit)] = fit - n
            want.append(fit)
        bins, offsets = packing.best_fit(lengths, size)
        assert len(set(bins)) == len(rooms)
        assert [size if f is None else f for f in want] == [size - o for o in offsets]


def test_sequences_hold_the_ids(odd, plain):
    docs = odd.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    parts = packing.pieces(docs)
    placed = packing.pack(parts).cache()
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(parts, placed).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    for r in placed.collect():
        ids = (plain(texts[r["doc_id"]]) + [2])[r["start"] : r["start"] + r["length"]]
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids


def test_empty_table(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
