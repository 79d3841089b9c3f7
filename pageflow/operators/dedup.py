"""De-duplication, set operations and visited state.

First-wins de-duplication never uses a window over the duplicate key (a hot key - e.g.
thousands of empty pages with one hash - would land in one task): the winner's order
value is found with a partial (map-side combined) ``min`` aggregate over narrow columns,
and the payload is filtered by an anti-join on the unique order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.functions import urls as U
from pageflow.operators.skew import salted_join


def first_wins(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """Keep, per ``key``, the row with the smallest ``order_col`` (``order_col`` unique).

    The payload is filtered with an anti-join on ``order_col`` against the "losers". When duplicates
    are rare that list is small and AQE broadcasts it by its measured size, so the payload
    (html, text) never moves; otherwise it is shuffled once. Rows without a key (a NULL body)
    are duplicates of nothing.
    """
    return df.join(losers(df, key, order_col), order_col, "left_anti")


def losers(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """``(order_col)`` of the rows that aren't the first of their key. Only narrow ``(key, order)``
    columns are shuffled: a partial ``min``/``count`` aggregate finds the keys that repeat, and
    the rows of a hot key are dealt over several tasks when they are compared with its first."""
    narrow = df.select(key.alias("_key"), F.col(order_col).alias("_ord")).filter(F.col("_key").isNotNull())
    groups = narrow.groupBy("_key").agg(F.min("_ord").alias("_win"), F.count("*").alias("_n")).filter("_n > 1")
    rows = salted_join(narrow, groups.select("_key", "_win"), ["_key"])
    return rows.filter(F.col("_ord") != F.col("_win")).select(F.col("_ord").alias(order_col))


def content_hash(c: str | Column) -> Column:
    """MD5 of the UTF-8 body (the content-hash key)."""
    return F.md5(F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8"))


def dedup_content(df: DataFrame, body_col: str, order_col: str) -> DataFrame:
    """First wins by fetch order per MD5 of the body; duplicates produce nothing."""
    return first_wins(df, content_hash(body_col), order_col)


def dedup_urls(df: DataFrame, url_col: str, order_col: str) -> DataFrame:
    """First wins per normalized URL key."""
    return first_wins(df, U.normalize_url(url_col), order_col)


def unseen(links: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Links not yet discovered (set difference on ``on``)."""
    return links.join(seen.select(*on).distinct(), on, "left_anti")


def filter_visited(df: DataFrame, visited: DataFrame, url_col: str = "url", keep: str = "unvisited") -> DataFrame:
    """D3: membership of the normalized key in the visited table (anti or semi join)."""
    keyed = df.withColumn("_vkey", U.normalize_url(url_col))
    v = visited.select(F.col("url").alias("_vkey"))
    how = "left_anti" if keep == "unvisited" else "left_semi"
    return keyed.join(v, "_vkey", how).drop("_vkey")


def new_visited_keys(visited: DataFrame, new: DataFrame, url_col: str = "url") -> DataFrame:
    """D4 delta: the normalized keys of ``new`` that the visited table lacks (distinct).
    Appending exactly these rows keeps the table key-unique without rewriting it."""
    return new.select(U.normalize_url(url_col).alias("url")).distinct().join(visited.select("url"), "url", "left_anti")


def mark_visited(visited: DataFrame, new: DataFrame, url_col: str = "url") -> DataFrame:
    """Insert-or-ignore: the visited table plus new normalized keys it lacks (the
    complete table as a view; to persist it, append :func:`new_visited_keys`)."""
    return visited.select("url").unionByName(new_visited_keys(visited, new, url_col))


def upsert_crawled(crawled: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert-or-replace by url with status; the latest (batch_no, ts) wins.

    Both inputs have ``url, ts, status, batch_no``. A partial ``max`` over a struct keyed
    by url: each url's rows combine map-side before the shuffle.
    """
    both = crawled.select("url", "ts", "status", "batch_no").unionByName(batch.select("url", "ts", "status", "batch_no"))
    latest = both.groupBy("url").agg(F.max(F.struct("batch_no", "ts", "status")).alias("w"))
    return latest.select("url", F.col("w.ts").alias("ts"), F.col("w.status").alias("status"), F.col("w.batch_no").alias("batch_no"))


def resume(visited: DataFrame, run_urls: DataFrame, url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """A run skips everything visited before and returns (urls to crawl, new visited table)."""
    todo = filter_visited(run_urls, visited, url_col).withColumn("_k", U.normalize_url(url_col)).dropDuplicates(["_k"]).drop("_k")
    return todo, mark_visited(visited, run_urls, url_col)
