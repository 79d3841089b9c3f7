"""pageflow: web-page snapshots to clean text, link graphs and crawl reports on Spark.

Column functions live in :mod:`pageflow.functions`, table operators in
:mod:`pageflow.operators`, readers and writers in :mod:`pageflow.sources`,
the registered queries and their DuckDB oracles in :mod:`pageflow.plans` and the
Structured Streaming jobs in :mod:`pageflow.streaming`.
"""

from pageflow.session import checkpoint_dir, get_session

__all__ = ["checkpoint_dir", "get_session"]
