"""Skew-proof ranking helpers equal plain windows, with one key holding a third of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pageflow.operators.ranking import rank_and_sum_in_groups, rank_in_groups, running_sum_in_groups


def _skewed(spark):
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("g"),
        F.col("id").alias("o"), (F.col("id") % 5).alias("v"))
    return df.repartition(13)


def test_rank_equals_window(spark):
    df = _skewed(spark)
    got = rank_in_groups(df, ["g"], ["o"], "rn")
    exp = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    j = got.join(exp, ["g", "o"])
    assert j.count() == 30000
    assert j.filter("rn != rn2").count() == 0


def test_running_sum_equals_window(spark):
    df = _skewed(spark)
    got = running_sum_in_groups(df, ["g"], ["o"], "v", "before")
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    exp = df.withColumn("b2", F.coalesce(F.sum("v").over(w), F.lit(0)))
    j = got.join(exp, ["g", "o"])
    assert j.count() == 30000
    assert j.filter("before != b2").count() == 0


def test_null_groups_text_none_and_large_values(spark):
    """NULL and the text 'None' are two groups, and values beyond 2^53 stay exact."""
    big = 2**53 + 1
    rows = [(None, 1, 0, None), (None, 2, 6, 0), ("None", 1, 7, 0), ("None", 2, 8, 0), ("a", 1, big, 1), ("a", 2, None, 1), ("a", 3, 1, 1), ("a\x1fb", 1, 5, None)]
    df = spark.createDataFrame([(g, o, v) for g, o, v, _ in rows], "g string, o long, v long")
    got = {(r.g, r.o): r.before for r in running_sum_in_groups(df, ["g"], ["o"], "v", "before").collect()}
    assert got == {(None, 1): 0, (None, 2): 0, ("None", 1): 0, ("None", 2): 7, ("a", 1): 0, ("a", 2): big, ("a", 3): big, ("a\x1fb", 1): 0}
    ranks = {(r.g, r.o): r.rn for r in rank_in_groups(df, ["g"], ["o"]).collect()}
    assert ranks == {k: k[1] for k in got}


def test_rank_and_sum_from_one_sort(spark):
    df = _skewed(spark)
    got = rank_and_sum_in_groups(df, ["g"], ["o"], "rn", F.when(F.col("rn") % 2 == 0, F.col("rn")), "before")
    w = Window.partitionBy("g").orderBy("o")
    exp = df.withColumn("rn2", F.row_number().over(w))
    exp = exp.withColumn("before2", F.coalesce(F.sum(F.when(F.col("rn2") % 2 == 0, F.col("rn2"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = got.join(exp.select("g", "o", "rn2", "before2"), ["g", "o"])
    assert both.count() == df.count() and both.filter("rn != rn2 OR before != before2").count() == 0


def test_schedule_equals_window(spark, sf_dir):
    from pageflow.operators import crawl as K
    from pageflow.plans import fixtures as X

    f = X.fetches(X.table(spark, sf_dir, "pages")).select("page_id", "host")
    got = K.fetch_schedule(f, 3, 1.0, ["host"], ["page_id"])
    exp = f.withColumn("seq2", F.row_number().over(Window.partitionBy("host").orderBy("page_id")))
    j = got.join(exp, ["page_id", "host"])
    assert j.count() == f.count()
    assert j.filter("seq != seq2 OR batch != floor((seq2 - 1) / 3)").count() == 0


def test_no_python_in_the_ranking(spark):
    df = _skewed(spark)
    plan = running_sum_in_groups(df, ["g"], ["o"], "v", "before")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
