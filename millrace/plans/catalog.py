"""All named queries."""

from __future__ import annotations

import importlib

_MODULES = ("relational_queries", "window_queries", "scalar_queries", "source_queries",
            "sink_queries", "quality_queries", "vector_queries", "text_queries",
            "versioned_queries", "stream_queries", "etl_queries")


def _sets():
    for name in _MODULES:
        yield importlib.import_module(f"millrace.plans.{name}").Q


def all_queries():
    return {name: fn for q in _sets() for name, fn in q.spark.items()}


def all_sql():
    return {name: sql for q in _sets() for name, sql in q.sql.items()}
