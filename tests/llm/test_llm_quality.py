import base64
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pageflow.llm import quality_model, quality_rules


def rules(text):
    """The base measures, plainly."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 1500 else {w for w in set(windows) if sum(x == w for x in windows) > 1}
    hit = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def same(rows):
    for text, r in rows:
        want = rules(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_on_odd_texts(odd):
    got = {r["doc_id"]: r for r in quality_rules.measures(odd).collect() if r["doc_id"] is not None}
    same([(t, got[i]) for i, t in odd.select("doc_id", "text").collect() if i is not None])


def test_rules_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in quality_rules.query(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    same([(r["text"], got[r["doc_id"]]) for r in rows if len(r["text"]) < 6000])
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    assert all(r["kept"] or r["base_failed"] for i, r in got.items() if i in good)


def test_bands_reject_repetition_and_noise(spark):
    rng = np.random.default_rng(0)
    prose = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(900))
    noise = " ".join("".join(map(chr, rng.integers(0x4E00, 0x9F00, 6))) for _ in range(400))
    half = prose + " " + " ".join(f"buy now {k % 10} cheap" for k in range(500))
    rows = [(0, prose), (1, noise), (2, " ".join(f"line {k % 7} of {k}" for k in range(3000))), (3, half)]
    got = {r["doc_id"]: r for r in quality_rules.measures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["kept"] and not got[2]["kept"] and got[3]["odd_share"] > 0.25 and not got[3]["kept"]


def test_bands_reject_noise_of_any_length_and_repetition_under_half(spark, sf_dir):
    rng = np.random.default_rng(4)
    words = lambda n: [base64.b64encode(rng.bytes(int(rng.integers(2, 10)))).decode().rstrip("=") for _ in range(n)]
    rows = [(k, " ".join(words(n // 4))[:n]) for k, n in enumerate((480, 1000, 4000, 20000, 60000))]
    rows += [(10 + k, " ".join("".join(map(chr, rng.integers(0x4E00, 0x9F00, 2))) for _ in range(n // 7))) for k, n in enumerate((480, 1000, 4000, 20000, 60000))]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    clean = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels, "doc_id").filter("length(text) BETWEEN 2500 AND 8000").orderBy("doc_id").limit(20).collect()
    for r in clean:
        w = r["text"].split()
        rows.append((100 + r["doc_id"], " ".join(w + w[: len(w) * 28 // 100])))
    got = quality_rules.measures(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 30 and not [r for r in got if r["base_failed"] or r["kept"]]


def prose(rng, words, n):
    return " ".join(rng.choice(words, n))


def corpus(seed=8, n=900):
    """Texts of random words with 60 to 1,500 words in two languages of different spread, and their ids."""
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    wide = ["".join(map(chr, rng.integers(0x4E00, 0x5200, 2))) for _ in range(3000)]
    return rng, [(k, "aa" if k % 3 else "zz", prose(rng, plain if k % 3 else wide, int(60 * 25 ** rng.random()))) for k in range(n)], plain


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, lang string, text string, ratio double")


def test_fitted_bands_against_plain_counts(spark):
    import math

    import zstandard

    _, rows, _ = corpus(n=3600)
    rows += [(5000 + k, "aa", rows[1][2]) for k in range(800)] + [(9000, None, None), (9001, "", ""), (9002, "rare", rows[2][2] + " end")]
    bands = quality_rules.fit(docs_of(spark, rows))
    logs = defaultdict(set)
    for _, lang, text in rows:
        raw = (text or "").encode()
        if len(raw.split()) >= 50:
            size, ratio = math.floor(2 * math.log2(len(raw))), len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw))
            for name in {lang, ""}:
                logs[name, size].add((math.floor(math.log(ratio) * 100), text))
    want, pool = {}, {}
    for name, size in sorted(logs):
        pool.setdefault(name, []).extend((s, size) for s, _ in logs[name, size])
        if len(pool[name]) >= quality_rules.LEAST_TEXTS:
            texts = pool.pop(name)
            place, steps = (name, sum(k for _, k in texts) / len(texts)), sorted(s for s, _ in texts)
            half = -(-len(steps) // 2)
            width, first = min((steps[k + half - 1] + 1 - steps[k], steps[k]) for k in range(len(steps) - half + 1))
            reach = max(0.1, 4.5 * width / 200 / 0.6745)
            want[place] = ((first + width / 2) / 100 - reach, (first + width / 2) / 100 + reach)
    got = {(name, c[0]): c[1:] for name, curve in bands.curves for c in curve if c[0] != quality_rules.CHUNKS}
    assert len(want) >= 6 and {k[0] for k in want} == {"", "aa", "zz"} and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_fitted_bands_keep_clean_texts_beside_a_third_of_noise_and_copies(spark):
    rng, rows, plain = corpus(n=1800)
    clean = {r[0] for r in rows}
    base64ish = lambda n: " ".join(base64.b64encode(rng.bytes(int(rng.integers(3, 10)))).decode().rstrip("=") for _ in range(n))
    noise = [(10_000 + k, "aa", base64ish(int(60 * 20 ** rng.random()))) for k in range(800)]
    again = [(20_000 + k, "aa", (w := prose(rng, plain, int(rng.integers(300, 900)))) + " " + w[: len(w) * 45 // 100]) for k in range(100)]
    copies = [(30_000 + k, "aa", rows[1][2]) for k in range(600)]
    docs = docs_of(spark, rows + noise + again + copies)
    got = {r["doc_id"]: r for r in quality_rules.measures(docs, bands=quality_rules.fit(docs)).collect()}
    left = lambda ids: sum(got[i]["kept"] for i in ids)
    assert not any(got[i]["base_failed"] for i in clean) and left(clean) >= 0.99 * len(clean)
    assert left(r[0] for r in copies) == len(copies)
    assert left(r[0] for r in noise) <= 0.05 * len(noise) and left(r[0] for r in again) <= 0.1 * len(again)
    kept = quality_rules.keep_good(docs, bands=quality_rules.fit(docs))
    assert kept.columns == docs.columns and kept.count() == left(got)


def test_fitted_bands_go_on_beyond_their_classes(spark):
    bands = quality_rules.FittedBands(curves=(("", ((20, 0.5, 0.8), (22, 0.6, 0.9))),))
    sizes = [1 << k for k in range(0, 40)]
    low, high = zip(*(bands.whole("xx", s) for s in sizes), strict=True)
    assert list(low) == sorted(low) and list(high) == sorted(high) and high[-1] > high[12] and low[0] < low[10]
    assert low[-1] < 1.9 and bands.whole(None, 0) == bands.whole(None, 1)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.fit(empty).whole("en", 600) == quality_rules.Bands().whole("en", 600) and quality_rules.measures(empty, bands=quality_rules.fit(empty)).count() == 0


def test_kept_rows_keep_their_columns(odd, spark):
    out = quality_rules.keep_good(odd)
    assert out.columns == odd.columns
    assert quality_rules.measures(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_classifier_on_held_out_rows(spark, sf_dir):
    got = quality_model.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    test = [r for r in got if r["held_out"] and r["quality"] is not None]
    share = sum(r["quality"] for r in test) / len(test)
    assert sum(r["predicted"] == r["quality"] for r in test) / len(test) > max(0.95, share + 0.05)


def test_held_out_labels_change_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 300")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    other = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_model.scores(docs, quality_model.train(docs, x)).orderBy("doc_id").collect() for x in (labels, other))
    assert a == b


def test_scores_of_odd_rows(odd, spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (6, 7), (7, 1), (9, 0), (10, 0), (None, 1)], "doc_id long, quality int")
    got = quality_model.scores(odd, quality_model.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality_model.scores(odd, quality_model.train(odd, none)).collect())


def test_flat_trees_against_walk():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 20, (400, 5))
    label = ((bins[:, 0] > 9) ^ (bins[:, 2] > 4)).astype(int)
    trees = quality_model.fit(bins, label, np.ones(400), trees=30, depth=3)
    for row, raw in zip(bins, trees.raw(bins), strict=True):
        total = trees.prior
        for t in range(len(trees.leaf)):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + (row[trees.feature[t, node]] > trees.cut[t, node])
            total += trees.leaf[t, node - 7]
        assert abs(total - raw) < 1e-9
    assert ((trees.raw(bins) > 0) == label).mean() > 0.9


def plain_statistics(text):
    """The thirty statistics one by one, over single bytes and words."""
    import math
    import string

    raw = (text or "").encode()
    if not raw:
        return [0.0] * 30
    chars, n = [chr(b) for b in raw], len(raw)
    share = lambda wanted: sum(c in wanted for c in chars) / n
    stop, sign, blank = ".,;:!?'\"()-", "#*$%&|<>{}[]\\/_=+~^@`", "\t\x0b\x0c\r \n"
    known = string.ascii_letters + string.digits + stop + sign + blank
    words = [w for w in re.split("[\t\x0b\x0c\r \n]+", "".join(chars)) if w]
    lines = [x for x in "".join(chars).split("\n") if x.strip(blank)]
    entropy = lambda items: -sum(c / len(items) * math.log2(c / len(items)) for c in Counter(items).values())
    per = lambda holds, of: sum(map(holds, of)) / max(1, len(of))

    def again(k):
        runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        seen = Counter(runs)
        return per(lambda r: seen[r] > 1, runs)

    sizes = [len(w) for w in words]
    mean = sum(sizes) / max(1, len(sizes))
    letters = string.ascii_letters
    return [
        math.log(1 + n), math.log(1 + len(words)), math.log(1 + len(lines)), share(string.ascii_lowercase), share(string.ascii_uppercase), share(string.digits), share(blank), share(stop), share(sign),
        sum(c >= "\x80" for c in chars) / n, sum(c < "\x80" and c not in known for c in chars) / n,
        mean, math.sqrt(per(lambda s: (s - mean) ** 2, sizes)), math.log(1 + max(sizes, default=0)), len(set(words)) / max(1, len(words)), max(Counter(words).values(), default=0) / max(1, len(words)), again(2), again(3),
        math.log(1 + n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), per(lambda x: x.rstrip(blank)[-1] in '.!?"', lines), entropy(chars), entropy(words) if words else 0.0,
        per(lambda w: any(c in letters for c in w) and not any(c in string.ascii_lowercase for c in w), words), per(lambda w: w[-1] in sign + "!", words),
        per(lambda w: all(c in string.digits for c in w), words), per(lambda s: s > 16, sizes), per(lambda w: w[-1] in ".,;:!?", words), share("!"), share("|"),
    ]


def test_statistics_against_plain_ones(odd, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 4000 AND doc_id % 5 = 0").select("text")
    texts = [r["text"] for r in odd.select("text").unionByName(docs).collect()] + ["x", "!", "| |", "\n.\n.\n", "A1 B2 a1", "ab " * 3, "\x00\x01 \x7f"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    got = {r["k"]: r["s"] for r in frame.select("k", quality_model.statistics_column("text").alias("s")).collect()}
    for k, t in enumerate(texts):
        assert np.allclose(got[k], plain_statistics(t), atol=1e-9), (t or "")[:80]
