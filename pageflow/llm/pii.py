"""Personal data by candidates and boosted trees (operator 1), in DataFrame functions alone.

1. Generators are regular expressions of high recall that propose overlapping spans: the four base
   kinds, and loose ones for addresses without a domain, number groups and long mixed tokens. Each is
   linear in the text (possessive, or anchored at the start of a run). Every document is read once; the
   candidates are narrow rows in a table of the shared folder.
2. Base candidates that pass their check (parts, digits, Luhn) are spans.
3. Loose candidates get format and context features and are scored by boosted trees. The trees learn
   what checked data look like, from features that don't show the check: weak labels are the base
   checks and, for tokens, the key words or quotes in front of them. Candidates with equal features are
   one row with a count; ``PATTERNS`` such rows at most, an equal part for each generator, drawn by count,
   are the training sample. A part of all rows is left out of the fit. All candidates of that part
   calibrate a threshold per generator: the lowest score above which at least ``PRECISION`` of them
   carry the label, from counts by score bucket.
4. Selected loose spans that touch no base span are added to the base spans.

The trees become a SQL expression. Positions are code points, ends exclusive. Null texts count as empty
and have no spans. Repeated rows and null ids each get a row. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageflow.llm.boosting import Trees, fit
from pageflow.llm.common import checkpointed, table, written

#: Distinct feature rows the trees may be fitted on, share of the labelled among selected ones.
PATTERNS, PRECISION = 4096, 0.97
#: Score buckets of a unit of log odds, and the log odds beyond which they end.
BUCKETS, FAR = 256, 32
KINDS = ("email", "ip", "card", "phone", "secret", "number", "handle")

_LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "handle": r"(?<![^\s<>(),;:\"@])[^\s<>(),;:\"@]++@[^\s<>(),;:\"@]++",
    "number": r"(?<![0-9A-Za-z])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+",
}
_NEEDS = {"email": "@", "handle": "@"}
_BASE_OF_LOOSE = {"handle": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"}
_KEY_WORDS = r"(?i)(password|passwd|pwd|token|secret|key)\s*[=:]?\s*[\"']?$"
_CONTEXT_WORDS = r"(?i)(mail|call|phone|tel|fax|card|visa|account|ip|host|address|id|ssn|login|contact)\W{0,3}$"
FEATURES = ("gen", "len", "digits", "seps", "upper", "lower", "turns", "before", "after", "said")


def _found(text: F.Column, kind: str, pattern: str) -> F.Column:
    """All matches of a pattern as structs; gap: code points between the last match and this one."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    item = lambda hit, k: F.struct(
        F.lit(kind).alias("gen"), k.alias("k"), F.length(F.get(gaps, k)).alias("gap"), hit.alias("hit"),
        F.right(F.get(gaps, k), F.lit(24)).alias("left"), F.left(F.get(gaps, k + 1), F.lit(2)).alias("right"),
    )
    may = F.instr(text, _NEEDS[kind]) > 0 if kind in _NEEDS else text.rlike("[0-9]")
    return F.when(may, F.transform(hits, item))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, gen, k, gap, hit, left, right): proposals in the order of each generator, written
    once; every input row has at least one row, whose gen is null if there is nothing else."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    some = F.when(F.col("text").rlike("[0-9@]"), F.array_compact(F.array(*[_found(F.col("text"), k, p) for k, p in (BASE | LOOSE).items()])))
    found = base.select("row", "doc_id", F.explode_outer(F.flatten(some)).alias("c"))
    return written(found.select("row", "doc_id", "c.*"), "candidates")


def _count(c: F.Column, pattern: str) -> F.Column:
    return F.regexp_count(c, F.lit(pattern))


def _luhn(digits: F.Column) -> F.Column:
    """Whether up to 19 digits pass the check sum."""
    plain = F.lpad(digits, 19, "0")
    twice = F.translate(plain, "0123456789", "0246813579")
    total = sum((F.substring(plain if k % 2 else twice, k, 1).cast("int") for k in range(1, 20)), F.lit(0))
    return total % 10 == 0


def placed(found: DataFrame) -> DataFrame:
    """Candidates with start, end (code points) and ``valid``: whether a base candidate passes its check."""
    order = Window.partitionBy("row", "gen").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(order)
    digits = F.regexp_replace("hit", "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split("hit", r"\."), lambda x: F.ltrim(x, F.lit("0")))
    ip = F.forall(parts, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    card = F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False)
    valid = F.when(F.col("gen") == "email", True).when(F.col("gen") == "ip", ip).when(F.col("gen") == "card", card).when(F.col("gen") == "phone", (n >= 10) & (n <= 15))
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit")).withColumn("valid", valid)


def _side(c: F.Column) -> F.Column:
    """Class of a neighbouring character; signs that give a label away count as white space."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"[\s+=\"':]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike("[A-Za-z]"), 3).otherwise(4)


def features(loose: DataFrame) -> DataFrame:
    """Small integer features of loose candidates, and the weak label."""
    hit = F.col("hit")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    number = F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False) | ((F.right("left", F.lit(1)) == "+") & (n >= 10) & (n <= 15)) | hit.rlike(r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$")
    label = F.when(F.col("gen") == "handle", hit.rlike(_BASE_OF_LOOSE["handle"])).when(F.col("gen") == "number", number).otherwise(F.col("left").rlike(_KEY_WORDS) | hit.startswith("AKIA"))
    least = lambda c, most: F.least(c, F.lit(most)).cast("int")
    made = {
        "gen": F.array_position(F.lit(list(LOOSE)), F.col("gen")).cast("int"),
        "len": least(F.length(hit), 63), "digits": least(n, 31), "seps": least(_count(hit, "[^A-Za-z0-9]"), 15),
        "upper": least(_count(hit, "[A-Z]"), 31), "lower": least(_count(hit, "[a-z]"), 31), "turns": least(_count(hit, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"), 15),
        "before": _side(F.right("left", F.lit(1))), "after": _side(F.left("right", F.lit(1))), "said": F.col("left").rlike(_CONTEXT_WORDS).cast("int"),
    }
    return loose.select("*", *[v.alias(f"f_{k}") for k, v in made.items()], F.coalesce(label, F.lit(False)).cast("int").alias("label"))


def train(scored: DataFrame, patterns: int = PATTERNS, precision: float = PRECISION) -> tuple[Trees, dict[int, float]]:
    """Trees from a sample of the feature rows, and each generator's threshold from all of them."""
    names = [f"f_{k}" for k in FEATURES]
    groups = checkpointed(scored.groupBy(*names, "label").count())
    # the least of -ln(u) / count: a draw by count without replacement, the same in each run
    draw = -F.log((F.pmod(F.xxhash64(*names, "label"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))) / F.col("count")
    rows = []
    for g in range(1, len(LOOSE) + 1):
        rows += groups.filter(F.col("f_gen") == g).orderBy(draw, *names, "label").limit(-(-patterns // len(LOOSE))).collect()
    rows.sort(key=lambda r: (-r["count"], *r[:-1]))
    data = np.array([[*r] for r in rows], np.int64).reshape(-1, len(names) + 2)
    bins, label, weight = data[:, :-2], data[:, -2], np.sqrt(data[:, -1].astype(float))
    held = np.array([sum((k + 3) * v for k, v in enumerate(row)) % 4 == 0 for row in bins.tolist()], bool)
    every = not (~held).any()
    if every:
        held[:] = False
    trees, limits = fit(bins[~held], label[~held], weight[~held], trees=24, depth=3), {}
    left_out = sum(((k + 3) * F.col(c) for k, c in enumerate(names)), F.lit(0)) % 4 == 0
    raw = groups.select("f_gen", "label", "count", F.expr(score_sql(trees)).alias("score"), left_out.alias("held"))
    bucket = F.floor(F.greatest(F.least("score", F.lit(float(FAR))), F.lit(float(-FAR))) * BUCKETS)
    sums = raw.groupBy("f_gen", "held", bucket.alias("bucket")).agg(
        F.min("score").alias("score"), F.sum("count").alias("n"), F.sum(F.col("count") * F.col("label")).alias("good"), F.count("*").alias("rows")
    )
    found = sums.collect()
    for g in range(1, len(LOOSE) + 1):
        own = [r for r in found if r["f_gen"] == g]
        if not every and sum(r["rows"] for r in own if r["held"]) >= 20:
            own = [r for r in own if r["held"]]
        limits[g], good, n, last = float("inf"), 0, 0, {}
        for r in own:  # a bucket is taken as a whole
            x = last.setdefault(r["bucket"], [r["score"], 0, 0])
            last[r["bucket"]] = [min(x[0], r["score"]), x[1] + r["good"], x[2] + r["n"]]
        for _, (score, right, count) in sorted(last.items(), reverse=True):
            good, n = good + right, n + count
            if good >= precision * n:
                limits[g] = score
    return trees, limits


def score_sql(trees: Trees) -> str:
    """The log odds of the trees as SQL over the feature columns."""

    def walk(t: int, node: int) -> str:
        inner = trees.feature.shape[1]
        if node >= inner:
            return repr(float(trees.leaf[t, node - inner])) + "D"
        f, cut = FEATURES[trees.feature[t, node]], trees.cut[t, node]
        a, b = walk(t, 2 * node + 1), walk(t, 2 * node + 2)
        return a if a == b else f"CASE WHEN f_{f} <= {cut} THEN {a} ELSE {b} END"

    return " + ".join([f"{trees.prior!r}D", *(walk(t, 0) for t in range(len(trees.leaf)))])


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: int = PATTERNS, precision: float = PRECISION) -> DataFrame:
    """(row, key, kind, start, end, base) of every selected span; a row without any has one with null kind."""
    found = candidates(docs, key, text)
    loose = features(found.filter(F.col("gen").isin(*LOOSE)))
    trees, limits = train(loose, patterns, precision)
    limit = F.when(F.lit(False), 0.0)
    for g, x in limits.items():
        if np.isfinite(x):
            limit = limit.when(F.col("f_gen") == g, F.lit(x))
    at = placed(found)
    scored = features(at).withColumn("chosen", F.expr(score_sql(trees)) >= limit - 1e-9)
    keep = F.coalesce(F.when(F.col("gen").isin(*BASE), F.col("valid")).otherwise(F.col("chosen")), F.lit(False))
    kept = scored.select("row", "doc_id", F.when(keep, F.col("gen")).alias("kind"), "start", "end", F.col("gen").isin(*BASE).alias("base"))
    # loose spans that touch a base span go
    by = Window.partitionBy("row").orderBy("start", "end")
    base_end, base_start = F.when(F.col("kind").isNotNull() & F.col("base"), F.col("end")), F.when(F.col("kind").isNotNull() & F.col("base"), F.col("start"))
    before = F.max(base_end).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(base_start).over(by.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    touched = ~F.col("base") & ((F.coalesce(before, F.lit(-1)) > F.col("start")) | (F.coalesce(after, F.col("end")) < F.col("end")))
    return kept.withColumn("touched", touched).select(
        "row", F.col("doc_id").alias(key), F.when(~F.coalesce("touched", F.lit(False)), F.col("kind")).alias("kind"), "start", "end", "base"
    )


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, the digest of the base spans and all spans of each row."""
    rank = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    one = F.struct(F.col("start"), rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("as_text"))
    listed = lambda when: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(when, one))), lambda x: x["as_text"]))
    out = spans(docs, key, text).groupBy("row").agg(
        F.first(key).alias(key),
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.col("kind").isNotNull() & F.col("base")), 256).alias("base_sha256"),
        listed(F.col("kind").isNotNull()).alias("spans"),
    )
    return out.drop("row")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one."""
    own = [c for c in docs.columns]
    mark = "_" + "_".join(own)
    may = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    plain, rich = docs.filter(~may), docs.filter(may)
    found = spans(rich.select(key, text, F.xxhash64(text).alias(mark)).select(F.struct(key, mark).alias(mark), text), mark, text)
    found = found.filter("kind IS NOT NULL")
    by = Window.partitionBy("row").orderBy("start", "end", "kind")
    top = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", (F.coalesce(top, F.lit(-1)) <= F.col("start")).cast("int"))
    found = found.withColumn("run", F.sum("new").over(by))
    runs = found.groupBy("row", mark, "run").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.min_by("kind", "start").alias("kind"))
    held = runs.groupBy("row", mark).agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind"))).alias("runs")).groupBy(mark).agg(F.first("runs").alias("runs"))
    # no name that the input could have: joined and read by names made from all of its columns
    at_key, at_hash, at_runs = (f"{mark}_{n}" for n in ("key", "hash", "runs"))
    held = held.select(F.col(f"`{mark}`.`{key}`").alias(at_key), F.col(f"`{mark}`.`{mark}`").alias(at_hash), F.col("runs").alias(at_runs))
    joined = rich.join(held, rich[key].eqNullSafe(held[at_key]) & (F.xxhash64(rich[text]) == held[at_hash]), "left")
    spans_ = F.col(f"`{at_runs}`")
    end = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(spans_, k - 1)["e"])
    pieces = F.transform(spans_, lambda r, k: F.concat(F.substring(rich[text], end(k) + 1, r["s"] - end(k)), F.lit("["), F.upper(r["kind"]), F.lit("]")))
    tail = F.substring(rich[text], F.element_at(spans_, -1)["e"] + 1, F.length(rich[text]))
    new = F.when(spans_.isNull(), rich[text]).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.select(*[new.alias(c) if c == text else rich[c] for c in own]).unionByName(plain)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacted documents; ``n_chars`` follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))
