"""Registered queries, derived fixture views, DuckDB oracles and the comparison helper."""
