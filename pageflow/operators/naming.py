"""Collision-free file names (U14) as sequential naming gives them, in a number of shuffles that depends on no chain.

A file takes its own name if it is free on arrival, else the first free of ``stem_1.ext``, ``stem_2.ext``, ... Number k
of a name X can only meet files that are called X_k from the start. So a group (all files called X) needs to know
its *children*: names X_k that occur themselves, with their first arrivals. Of these

* k is skipped if the child came before the file that would take k: with r files of X before the child's arrival and
  g numbers skipped below k, iff ``k - g > r``. One fold over a group's children in the order of k.
* otherwise X takes the child's own name, and the child's first file has to start with a number. Whether a group's own
  name is taken is thus a function of the same fact about its parent, and chains of parents are composed by
  doubling.

A file is then numbered by its rank and the skipped numbers below it. Groups without children and parents, nearly all,
are numbered by rank alone. Hot names are split throughout: ranks and sums come from ``ranking``, joins are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.functions import urls as U
from pageflow.operators.ranking import rank_in_groups, running_sum_in_groups
from pageflow.operators.skew import salted_join
from pageflow.session import checkpoint_dir

# The last dot and what follows, if a character other than a dot comes before it.
EXTENSION = r"(?s)[^.].*(\.[^.]*)$"
STRETCH = 256


def _extension(name: Column) -> Column:
    return F.regexp_extract(name, EXTENSION, 1)


def numbered_name(name: Column, number: Column) -> Column:
    """``stem_number.ext``; the name itself for 0."""
    ext = _extension(name)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(number == 0, name).otherwise(F.concat(stem, F.lit("_"), number.cast("string"), ext))


def _written(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def child_names(firsts: DataFrame) -> DataFrame:
    """(scope, parent, k, name, first): the names in ``firsts`` (scope, name, first) that are a number of another one."""
    ext = _extension(F.col("name"))
    stem = F.substring(F.col("name"), F.lit(1), F.length("name") - F.length(ext))
    number = r"(?s)^(.*)_([1-9][0-9]{0,17})$"
    parts = firsts.select("scope", "name", "first", F.concat(F.regexp_extract(stem, number, 1), ext).alias("parent"), F.regexp_extract(stem, number, 2).alias("digits"))
    parts = parts.filter("digits <> ''").withColumn("k", F.col("digits").cast("long")).filter(numbered_name(F.col("parent"), F.col("k")) == F.col("name"))
    known = firsts.select("scope", F.col("name").alias("parent"))
    return parts.join(known, ["scope", "parent"], "left_semi").select("scope", "parent", "k", "name", "first")


def _folded(children: DataFrame) -> DataFrame:
    """(scope, parent, name, k, and by z: g and skipped) of every child; z is 1 where the parent's own name is taken, and
    the children have ``before``, the number of the parent's files that came before them."""
    fields = "struct<name: string, k: bigint, g0: bigint, s0: boolean, g1: bigint, s1: boolean>"
    none, nones = F.expr(f"CAST(array() AS array<{fields}>)"), F.expr(f"CAST(array() AS array<array<{fields}>>)")

    def one(state: Column, c: Column) -> Column:
        skipped0 = c["k"] - state["g0"] > F.greatest(c["before"] - 1, F.lit(0))  # the first file has the own name
        skipped1 = c["k"] - state["g1"] > c["before"]
        row = F.struct(c["name"].alias("name"), c["k"].alias("k"), state["g0"].alias("g0"), skipped0.alias("s0"), state["g1"].alias("g1"), skipped1.alias("s1"))
        return F.struct((state["g0"] + skipped0.cast("long")).alias("g0"), (state["g1"] + skipped1.cast("long")).alias("g1"), F.concat(state["out"], F.array(row)).alias("out"))

    def stretch(state: Column, part: Column) -> Column:  # results of a stretch are copied with no later stretch
        start = F.struct(state["g0"].alias("g0"), state["g1"].alias("g1"), none.alias("out"))
        return U.let(F.aggregate(part, start, one), lambda r: F.struct(r["g0"].alias("g0"), r["g1"].alias("g1"), F.concat(state["outs"], F.array(r["out"])).alias("outs")))

    held = children.groupBy("scope", "parent").agg(F.array_sort(F.collect_list(F.struct("k", "before", "name"))).alias("of"))
    parts = F.transform(F.sequence(F.lit(0), F.size("of") - 1, F.lit(STRETCH)), lambda a: F.slice("of", a + 1, F.lit(STRETCH)))
    zero = F.struct(F.lit(0).cast("long").alias("g0"), F.lit(0).cast("long").alias("g1"), nones.alias("outs"))
    return held.select("scope", "parent", F.inline(F.aggregate(parts, zero, stretch, lambda s: F.flatten(s["outs"]))))


def _own_name_taken(folded: DataFrame) -> DataFrame:
    """(scope, name, z) of every child group: whether its parent takes its name first."""
    todo = _written(folded.select("scope", "name", "parent", (~F.col("s0")).alias("f0"), (~F.col("s1")).alias("f1")))
    while True:
        up = todo.select("scope", F.col("name").alias("parent"), F.col("parent").alias("above"), F.col("f0").alias("p0"), F.col("f1").alias("p1"))
        both = todo.join(up, ["scope", "parent"], "left")
        through = lambda p, f: F.when(F.col(p).isNull(), F.col(f)).when(F.col(p), F.col("f1")).otherwise(F.col("f0"))
        # each round doubles how far up a function reaches; a parent without one is a root, whose name is free
        todo = _written(both.select("scope", "name", F.col("above").alias("parent"), through("p0", "f0").alias("f0"), through("p1", "f1").alias("f1")))
        if not todo.filter("parent IS NOT NULL").limit(1).count():
            return todo.select("scope", "name", F.col("f0").cast("long").alias("z"))


def assign_filenames(files: DataFrame, order_col: str, category_col: str = "category", scope: tuple[str, ...] = ("host",)) -> DataFrame:
    """Collision-free file names per (scope, category) in arrival order, each file's first free name.

    The name is the path basename (``md5(url).unknown`` when empty), then its numbers from 1. ``order_col`` is unique
    inside a (scope, category). Adds ``original_name`` and ``filename``.
    """
    base = F.regexp_extract(U.url_path("url"), r"([^/]*)$", 1)
    original = F.when(base == "", F.concat(U.url_key("url"), F.lit(".unknown"))).otherwise(base)
    keys = [*scope, category_col]
    named = files.withColumn("original_name", original)
    ranked = rank_in_groups(named, [*keys, "original_name"], [order_col], "_rank")
    at = F.to_json(F.struct(*keys)).alias("scope")
    rows = ranked.select("*", at, F.col("original_name").alias("name"))
    narrow = rows.select("scope", "name", F.col(order_col).alias("t"))
    children = _written(child_names(narrow.groupBy("scope", "name").agg(F.min("t").alias("first"))))
    if not children.limit(1).count():
        return ranked.withColumn("filename", numbered_name(F.col("original_name"), F.col("_rank") - 1)).drop("_rank")

    parents = children.select("scope", F.col("parent").alias("name")).distinct()
    arrivals = salted_join(narrow, parents, ["scope", "name"], "left_semi").select("scope", "name", "t", F.lit(1).alias("one"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("string").alias("child"))
    events = arrivals.unionByName(children.select("scope", F.col("parent").alias("name"), F.col("first").alias("t"), F.lit(0).alias("one"), "k", F.col("name").alias("child")))
    counted = running_sum_in_groups(events, ["scope", "name"], ["t", "one"], "one", "before").filter("child IS NOT NULL")
    folded = _written(_folded(counted.select("scope", F.col("name").alias("parent"), "k", "before", F.col("child").alias("name"))))
    taken = _own_name_taken(folded)

    groups = parents.join(taken, ["scope", "name"], "full").select("scope", "name", F.coalesce("z", F.lit(0)).alias("z"))
    groups = _written(groups)
    by_z = folded.join(groups.withColumnRenamed("name", "parent"), ["scope", "parent"])
    pick = lambda c: F.when(F.col("z") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    # a number that was skipped moves every file from place k - g on
    moved = by_z.filter(pick("s")).select("scope", F.col("parent").alias("name"), (F.col("k") - pick("g")).alias("place"), F.lit(1).alias("one"))

    hit = salted_join(rows, groups, ["scope", "name"], "left")
    plain = hit.filter("z IS NULL").withColumn("number", F.col("_rank") - 1)
    placed = hit.filter("z IS NOT NULL").withColumn("place", F.col("_rank") - 1 + F.col("z")).withColumn("one", F.lit(0))
    lines = placed.unionByName(moved, allowMissingColumns=True).withColumn("file", (F.col("one") == 0).cast("int"))
    summed = running_sum_in_groups(lines, ["scope", "name"], ["place", "file"], "one", "skipped").filter("file = 1")
    numbered = summed.withColumn("number", F.when(F.col("place") == 0, F.lit(0)).otherwise(F.col("place") + F.col("skipped")))
    both = plain.select(*named.columns, "number").unionByName(numbered.select(*named.columns, "number"))
    return both.withColumn("filename", numbered_name(F.col("original_name"), F.col("number"))).drop("number")
