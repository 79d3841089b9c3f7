"""Attempts, failures and crawl statistics.

``attempts(url, endpoint, ts, ok, latency, seq)`` is one row per request try; ``seq``
breaks ties on ``ts``. Per-url questions aggregate by url (hash aggregate with partial
combine); nothing is ranked globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.functions.urls import CATALOGUES
from pageflow.operators.skew import salted_join


def retry_outcome(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """Per url the first successful attempt within ``max_retries``, else failed.

    Output ``url, ok, attempts_used`` (attempts until success, or ``max_retries``/all tries).
    The success position is the count of tries up to the first ok, computed from
    ``min(struct(ts, seq))`` of ok rows - no per-url sort of all tries, and the tries of a hot url
    are dealt over several tasks.
    """
    first_ok = attempts.filter("ok").groupBy("url").agg(F.min(F.struct("ts", "seq")).alias("f"))
    tries = salted_join(attempts.select("url", "ts", "seq"), first_ok, ["url"], "left")
    before = F.when(F.col("f").isNull() | (F.struct("ts", "seq") <= F.col("f")), 1).otherwise(0)
    per_url = tries.groupBy("url").agg(F.sum(before).alias("upto"), F.max(F.col("f").isNotNull()).alias("has_ok"), F.count("*").alias("n"))
    ok = F.col("has_ok") & (F.col("upto") <= max_retries)
    return per_url.select(
        "url",
        ok.alias("ok"),
        F.when(ok, F.col("upto")).otherwise(F.least(F.col("n"), F.lit(max_retries))).cast("long").alias("attempts_used"),
    )


def backoff(attempts: DataFrame, delay: float) -> DataFrame:
    """After failed attempt n (1-based) wait ``delay * n`` (also after the last one):
    ``wait_s`` per try and ``total_wait_s``, what the url has waited up to and with it."""
    from pageflow.operators.ranking import rank_and_sum_in_groups

    units = F.when(~F.col("ok"), F.col("attempt")).otherwise(F.lit(0))
    n = rank_and_sum_in_groups(attempts, ["url"], ["ts", "seq"], "attempt", units, "_before")
    return n.withColumn("wait_s", F.lit(delay) * units).withColumn("total_wait_s", F.lit(delay) * (F.col("_before") + units)).drop("_before")


def failed_urls(outcome: DataFrame) -> DataFrame:
    """The failed-URL set from ``retry_outcome`` as a table (one row per url; never
    gathered into one array), with the per-url error increment."""
    return outcome.filter(~F.col("ok")).select("url", F.lit(1).cast("long").alias("errors"))


# What an outcome class adds to, by source of the error.
ERROR_SOURCES = ("retries", "download", "parse")


def error_counts(retries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """T3 counter by source: urls whose retries ran out, requests of pages and files that failed, and
    bodies that could not be parsed. One row per source, also where nothing failed."""
    outs = outcomes.agg(F.count_if(F.col("outcome").isin("error", "not_found")).alias("download"), F.count_if(F.col("outcome") == "parse_error").alias("parse"))
    both = retries.agg(F.count_if(~F.col("ok")).alias("retries")).select(F.array(F.struct(F.lit(ERROR_SOURCES[0]).alias("source"), F.col("retries").alias("errors"))).alias("r"))
    rest = outs.select(F.array(*[F.struct(F.lit(k).alias("source"), F.col(k).alias("errors")) for k in ERROR_SOURCES[1:]]).alias("r"))
    return both.unionAll(rest).select(F.inline("r"))


def failed_fetches(outcomes: DataFrame) -> DataFrame:
    """T4: the failed list of a crawl as a table: each URL whose request or parse failed, with the class."""
    return outcomes.filter(F.col("outcome").isin("error", "not_found", "parse_error")).select("host", "url", "outcome")


def crawl_stats(fetches: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """T4: per site: pages processed (no duplicates, no failures), files downloaded, duplicates, errors,
    first/last fetch and duration (T9), ``pages_fetched`` and ``pages_crawled``, the distinct URLs that were discovered: those of
    ``discovered(host, url)`` (seen set, links) and the fetched ones. The failed list stays a table
    (``failed_fetches``). Input has ``host, url, outcome, fetch_ts``."""
    ok_page = F.col("outcome").isin("html_ok", "html_empty", "pdf_ok", "pdf_empty")
    err = F.col("outcome").isin("error", "not_found", "parse_error")
    stats = fetches.groupBy("host").agg(
        F.count_if(ok_page).alias("pages_processed"),
        F.count_if(F.col("outcome") == "downloaded").alias("files_downloaded"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(err).alias("errors"),
        F.min("fetch_ts").alias("start_time"),
        F.max("fetch_ts").alias("end_time"),
        (F.unix_timestamp(F.max("fetch_ts")) - F.unix_timestamp(F.min("fetch_ts"))).alias("duration_s"),
        F.count_distinct("url").alias("pages_fetched"),
    )
    if discovered is None:
        return stats.withColumn("pages_crawled", F.col("pages_fetched"))
    # distinct first: a link that many pages share is one row before anything is counted by site
    urls = fetches.select("host", "url").unionByName(discovered.select("host", "url")).distinct()
    return stats.join(urls.groupBy("host").agg(F.count("url").alias("pages_crawled")), "host")


def files_by_category(files: DataFrame, catalogue: str = "wide", scope: tuple[str, ...] = ("host",)) -> DataFrame:
    """T5: distinct downloaded URLs per category, zero-filled over all categories.

    Every scope key gets one row per catalogue category (a literal array exploded per
    key - a fixed, small fan-out), left-joined to the counts.
    """
    cats = F.array(*[F.lit(c) for c in CATALOGUES[catalogue]])
    counts = files.groupBy(*scope, "category").agg(F.count_distinct("url").alias("files"))
    grid = files.select(*scope).distinct().select(*scope, F.explode(cats).alias("category"))
    return grid.join(counts, [*scope, "category"], "left").select(*scope, "category", F.coalesce("files", F.lit(0)).cast("long").alias("files"))


def endpoint_stats(attempts: DataFrame) -> DataFrame:
    """Per endpoint: requests, successes, failures, mean latency of successes."""
    return attempts.groupBy("endpoint").agg(
        F.count("*").alias("total_used"),
        F.count_if("ok").alias("successful_requests"),
        F.count_if(~F.col("ok")).alias("failed_requests"),
        F.avg(F.when(F.col("ok"), F.col("latency"))).alias("speed"),
    )


def rank_endpoints(stats: DataFrame) -> DataFrame:
    """Working endpoints (at least one success) fastest first, missing speed last; the numbering
    is split over range partitions like any other."""
    from pageflow.operators.ranking import rank_in_groups

    working = stats.filter(F.col("successful_requests") > 0)
    keyed = working.withColumn("_all", F.lit(0)).withColumn("_missing", F.col("speed").isNull())
    return rank_in_groups(keyed, ["_all"], ["_missing", "speed", "endpoint"], "speed_rank").drop("_all", "_missing")


def assign_round_robin(df: DataFrame, n: int, group_cols: list[str], order_cols: list[str]) -> DataFrame:
    """The i-th row (in order) of each group goes to endpoint ``(i-1) mod n``."""
    from pageflow.operators.ranking import rank_in_groups

    r = rank_in_groups(df, group_cols, order_cols, "rr_seq")
    return r.withColumn("endpoint", F.pmod(F.col("rr_seq") - 1, F.lit(n)).cast("long"))


def durations(attempts: DataFrame) -> DataFrame:
    """Per url first and last try and the duration in seconds."""
    return attempts.groupBy("url").agg(
        (F.expr("timestampdiff(MICROSECOND, min(ts), max(ts))") / F.lit(1e6)).alias("duration_s"),
        F.count("*").alias("tries"),
    )
