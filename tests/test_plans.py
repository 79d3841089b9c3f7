"""Plan guards: no Python in the hot path, no shuffle for link edges, pruned scans."""

import pytest

from pageflow.plans.catalog import QUERIES

# queries that run jobs while being built (loops, streams, sinks) are covered elsewhere
BUILT_WITH_JOBS = ("crawl_reach", "crawl_budget", "crawl_depth_limited", "stream_", "_sink", "file_scan", "assign_filenames")
CHEAP = [n for n in QUERIES if not any(k in n for k in BUILT_WITH_JOBS)]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHEAP)
def test_no_python_in_plan(spark, sf_dir, name):
    plan = _plan(QUERIES[name][0](spark, sf_dir))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in plan, (name, node)


def test_link_edges_has_no_shuffle(spark, sf_dir):
    plan = _plan(QUERIES["link_edges"][0](spark, sf_dir))
    assert "Exchange" not in plan


def test_scans_are_pruned(spark, sf_dir):
    plan = _plan(QUERIES["page_title"][0](spark, sf_dir))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    plan = _plan(QUERIES["dedup_urls"][0](spark, sf_dir))
    assert "html" not in plan


def _exchanged(plan: str) -> str:
    """Output columns of everything below an Exchange."""
    return "\n".join(x for x in plan.split("\n") if "Exchange" in x or "Project" in x or "Scan" in x)


@pytest.mark.parametrize("name", ["crawl_outcomes", "crawl_stats", "failed_fetches"])
def test_bodies_are_not_shuffled(spark, sf_dir, name):
    df = QUERIES[name][0](spark, sf_dir)
    lines = _plan(df).split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    for i, line in enumerate(lines):
        if "Exchange" in line:
            below = next(x for x in lines[i + 1 :] if depth(x) > 0)
            if "Project" in below:
                assert "html#" not in below.split("AS")[-1]
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    for line in optimized.split("\n"):
        if "Join" in line:
            assert "html" not in line


def test_resolving_links_needs_no_shuffle(spark, sf_dir):
    assert "Exchange" not in _plan(QUERIES["url_resolve"][0](spark, sf_dir))


def test_no_cartesian_products(spark, sf_dir):
    for name in CHEAP:
        plan = _plan(QUERIES[name][0](spark, sf_dir))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
