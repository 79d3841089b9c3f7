"""The crawl as an iterative table job (K1-K6).

The fetched pages are a snapshot table; the crawl is breadth-first reachability over the
link graph from per-site seeds, run level by level: one small set of Spark jobs per
level (frontier join pages, join edges, anti-join seen, first-discoverer aggregate).
Sites are a column, so every site crawls in the same job. The loop ends on an empty frontier.

Scale notes
* Page keys and edges are bucketed tables, the seen set and the consumed body hashes growing ones
  (``state``): a level's joins shuffle the frontier and its candidate links alone, a level adds its rows instead
  of rewriting the rest, and additions are merged, so that deep sites don't leave thousands of small files.
  The last levels' rows, up to ``RECENT_ROWS``, are read from the level log: small levels write no buckets.
* Nothing is grouped by site: order inside a level is a sorted position, a site's count is a small running
  table joined with salts, and a body that many pages share is first reduced to one row.
* A level log in the shared folder holds every whole level: the URLs found and the next frontier. It cuts the
  lineage, survives lost executors, and a crawl that is started again on the log of a lost driver goes on from
  the last whole level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.functions import urls as U
from pageflow.operators.ranking import rank_in_groups, running_sum_in_groups
from pageflow.operators.skew import salted_join
from pageflow.operators.state import ROWS_PER_TASK, Bucketed, Growing, lacking
from pageflow.session import checkpoint_dir
from pageflow.sources.commits import CommitLog

PAGE_EXTS = (".html", ".htm")
#: Rows of levels that are read from the level log itself before they go into the growing tables.
RECENT_ROWS = 100_000


def expandable_route(url_col: str = "url", html_as_page: bool = True) -> F.Column:
    """U10 inside the crawl: file URLs expand nothing; by default ``.html/.htm`` count as pages."""
    cat = U.file_category(url_col)
    page = cat.isNull()
    if html_as_page:
        page = page | U.url_suffix(url_col).isin(*PAGE_EXTS)
    return page


def page_keys(pages: DataFrame) -> DataFrame:
    """Snapshot keyed by normalized URL, first page_id wins on key collisions (D8):
    ``(host, url, h)`` with ``h`` the body hash."""
    from pageflow.operators.dedup import content_hash, first_wins

    keyed = pages.select("page_id", U.url_netloc("url").alias("host"), U.normalize_url("url").alias("url"), content_hash("html").alias("h"))
    return first_wins(keyed, F.struct("host", "url"), "page_id").drop("page_id")


def _checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class LevelLog:
    """The whole levels of a crawl in a folder. Commit 0 has the seeds as first frontier, commit d + 1 the URLs found
    at depth d and the frontier behind them. Files of a level that was never committed are not read."""

    FOUND = "host string, url string, h string, ord bigint, expands boolean, processed boolean, status string, depth int"
    FRONTIER = "host string, url string, ord bigint"

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.commits = CommitLog(spark, f"{self.folder}/levels")
        self.levels = [self.commits.read(n) for n in self.commits.numbers()]
        self.settings = settings
        if self.levels and self.levels[0]["settings"] != settings:
            raise ValueError(f"the crawl in {folder} was started with {self.levels[0]['settings']}, not {settings}")

    @property
    def depth(self) -> int:
        """The depth of the frontier that comes next."""
        return len(self.levels) - 1

    def write(self, name: str, df: DataFrame) -> str:
        path = f"{name}-{len(self.levels)}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{path}")
        return path

    def read(self, schema: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths])

    def commit(self, found: str | None, frontier: str) -> int:
        """Adds a level; returns the rows of its frontier."""
        rows = self.read(self.FRONTIER, [frontier]).count()
        level = {"found": found, "next": frontier, "rows": rows} | ({} if self.levels else {"settings": self.settings})
        self.commits.commit(len(self.levels), level)
        self.levels.append(level)
        return rows

    def frontier(self) -> DataFrame:
        return self.read(self.FRONTIER, [self.levels[-1]["next"]])

    def seen(self, since: int = 0) -> DataFrame:
        """The URLs of the frontiers from commit ``since`` on."""
        return self.read(self.FRONTIER, [x["next"] for x in self.levels[since:] if x["rows"]]).select("host", "url")

    def consumed(self, since: int = 0) -> DataFrame:
        """The body hashes that the levels used up which were committed from ``since`` on."""
        return _consumed(self.read(self.FOUND, [x["found"] for x in self.levels[since:] if x["found"]]))

    def found(self) -> DataFrame:
        """Every URL found so far."""
        return self.read(self.FOUND, [x["found"] for x in self.levels[1:]])


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """``df`` sorted over range partitions, with ``ord`` rising along ``order``; a hot site is split, and few rows are few
    partitions. To be written once, so that every reader sees the same positions."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())


def crawl_reach(
    seeds: DataFrame,
    edges: DataFrame,
    pages: DataFrame,
    max_depth: int = 0,
    max_pages: int = 0,
    dedup: bool = True,
    html_as_page: bool = True,
    log: str | None = None,
) -> DataFrame:
    """K1-K4: breadth-first crawl.

    ``seeds(host, url)`` normalized keys; ``edges(host, src, dst, pos)``; ``pages`` the
    snapshot (``page_id, url, html``). A discovered URL missing from the snapshot is
    failed and expands nothing; file URLs and duplicate bodies (first wins in discovery
    order) expand nothing. ``max_depth`` (K2): URLs deeper than it are not processed
    (0 = unlimited). ``max_pages`` (K3): a page is processed only while the site's
    discovered count is below it (0 = unlimited); one page may overshoot.

    ``log``: a folder in shared storage. A crawl whose driver was lost goes on from its last whole level
    when it is started again with the same folder, inputs and limits; a crawl that had ended only returns its result.

    Returns ``(host, url, depth, rank, status)``: every discovered URL with its depth,
    its discovery rank inside the site (K4) and one of processed / failed / file /
    duplicate / skipped.
    """
    spark = edges.sparkSession
    folder = log or f"{checkpoint_dir(spark).rstrip('/')}/crawl-{uuid.uuid4().hex}"
    held = LevelLog(spark, folder, {"max_depth": max_depth, "max_pages": max_pages, "dedup": dedup, "html_as_page": html_as_page})
    if not held.levels:
        held.commit(None, held.write("next", _in_order(seeds.select("host", "url").distinct(), "host", "url")))
    if held.levels[-1]["rows"]:
        _crawl_levels(held, edges, pages)
    return rank_in_groups(held.found().select("host", "url", "depth", "ord", "status"), ["host"], ["depth", "ord"], "rank").select("host", "url", "depth", "rank", "status")


def _crawl_levels(held: LevelLog, edges: DataFrame, pages: DataFrame) -> None:
    """Runs levels until a frontier is empty. All state but the log is made from it (and from the inputs) at the start."""
    spark = held.spark
    max_depth, max_pages, dedup, html_as_page = (held.settings[k] for k in ("max_depth", "max_pages", "dedup", "html_as_page"))
    keys = Bucketed(spark, ["host", "url"]).add(page_keys(pages))
    links = Bucketed(spark, ["host", "src"]).add(edges.select("host", "src", "dst", "pos"))
    seen, hashes = Growing(spark, ["host", "url"]), Growing(spark, ["host", "h"])
    rows = held.levels[-1]["rows"]
    kept = 0  # commits of the log that the growing tables have; later ones are read from the log itself
    counts = _checkpointed(held.seen().groupBy("host").agg(F.count("*").alias("n_seen"))) if max_pages else None
    while rows:
        depth = held.depth
        more = sum(x["rows"] for x in held.levels[kept:])
        if more > RECENT_ROWS:
            seen.add(held.seen(kept), more)
            if dedup:
                hashes.add(held.consumed(kept), more)
            kept = len(held.levels)
        recent = kept < len(held.levels)
        few = rows <= keys.buckets * ROWS_PER_TASK
        deep = bool(max_depth) and depth > max_depth
        f = level_frontier(held.frontier(), keys.rows(), few)
        page = F.lit(False) if deep else expandable_route("url", html_as_page)
        f = f.withColumn("alive", F.col("h").isNotNull() & page)
        if dedup:
            # the first page of each new body in the level; one row per body meets the consumed ones
            first = f.filter("alive").groupBy("host", "h").agg(F.min("ord").alias("ord"))
            first = lacking(first, [*hashes.tables(), *([held.consumed(kept)] if recent else [])], ["host", "h"])
            f = f.join(first.select("host", "ord", F.lit(True).alias("first")), ["host", "ord"], "left")
            f = f.withColumn("dup", F.col("alive") & F.col("first").isNull()).drop("first")
        else:
            f = f.withColumn("dup", F.lit(False))
        status = (
            F.when(F.col("h").isNull(), F.lit("failed"))
            .when(F.col("dup"), F.lit("duplicate"))
            .when(~expandable_route("url", html_as_page), F.lit("file"))
            .when(F.lit(deep), F.lit("skipped"))
            .otherwise(F.lit("processed"))
        )
        level = f.select("host", "url", "h", "ord", (F.col("alive") & ~F.col("dup")).alias("expands"), F.lit(True).alias("processed"), status.alias("status"), F.lit(depth).alias("depth"))
        at = held.write("found", level)
        level = held.read(held.FOUND, [at])
        new = level_links(level, links.rows(), [*seen.tables(), *([held.seen(kept)] if recent else [])], few)
        if max_pages:
            # K3: pages of this level run in order while discovered(site) < max_pages
            new = _checkpointed(new)
            per_parent = new.groupBy("host", F.col("parent").alias("ord")).agg(F.count("*").alias("n_new"))
            runs = level.join(per_parent, ["host", "ord"], "left").fillna(0, ["n_new"])
            runs = salted_join(running_sum_in_groups(runs, ["host"], ["ord"], "n_new", "before"), counts, ["host"])
            runs = runs.withColumn("processed", F.col("n_seen") + F.col("before") < max_pages)
            at = held.write("found", runs.withColumn("status", F.when(F.col("processed"), F.col("status")).otherwise("skipped")).select(*level.columns))
            level = held.read(held.FOUND, [at])
            ran = level.filter("processed AND expands").select("host", F.col("ord").alias("parent"))
            new = new.join(ran, ["host", "parent"], "left_semi")
        behind = held.write("next", _in_order(new, "host", "parent", "pos", "url").select("host", "url", "ord"))
        rows = held.commit(at, behind)
        if rows and max_pages:
            fresh = held.frontier().groupBy("host").agg(F.count("*").alias("n_seen"))
            counts = _checkpointed(counts.unionByName(fresh).groupBy("host").agg(F.sum("n_seen").alias("n_seen")))
    for table in (keys, links, seen, hashes):
        table.forget()


def _consumed(level: DataFrame) -> DataFrame:
    """The body hashes that pages of a level used up."""
    return level.filter("processed AND expands").select("host", "h")


def _hashed(df: DataFrame, few: bool) -> DataFrame:
    """With ``few`` rows a task, ``df`` is hashed where it meets a whole table, which then isn't sorted."""
    return df.hint("shuffle_hash") if few else df


def level_frontier(frontier: DataFrame, keys: DataFrame, few: bool = False) -> DataFrame:
    """The frontier with the body hash of each URL that is in the snapshot."""
    return _hashed(frontier.select("host", "url", "ord"), few).join(keys, ["host", "url"], "left")


def level_links(f: DataFrame, links: DataFrame, seen: list[DataFrame], few: bool = False) -> DataFrame:
    """(host, url, parent, pos): URLs not seen before, each with its first discoverer in the level."""
    parents = _hashed(f.filter("expands").select("host", F.col("url").alias("src"), F.col("ord").alias("parent")), few)
    found = parents.join(links, ["host", "src"]).select("host", F.col("dst").alias("url"), "parent", "pos")
    first = found.groupBy("host", "url").agg(F.min(F.struct("parent", "pos")).alias("by"))
    return lacking(first, seen, ["host", "url"]).select("host", "url", "by.parent", "by.pos")


def assign_batches(df: DataFrame, k: int, group_cols: list[str], order_cols: list[str]) -> DataFrame:
    """K5: rows of each site in order, ``k`` per round: ``batch = floor((row_number - 1) / k)``."""
    r = rank_in_groups(df, group_cols, order_cols, "seq")
    return r.withColumn("batch", F.floor((F.col("seq") - 1) / F.lit(k)).cast("long"))


def fetch_schedule(df: DataFrame, k: int, delay: float, group_cols: list[str], order_cols: list[str]) -> DataFrame:
    """K6: politeness plan: a site's round ``b`` starts ``b * delay`` seconds after its first."""
    b = assign_batches(df, k, group_cols, order_cols)
    return b.withColumn("offset_s", F.col("batch") * F.lit(float(delay)))
