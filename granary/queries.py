"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from granary import queries_more, queries_plans, queries_render, queries_select, queries_stats  # noqa: F401
from granary.engine import optimized
from granary.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark, sf_dir):
    """A budgeted context: filter, rows that fit, then sorted and rendered."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").drop("ts")
    return optimized(events, ["event_id"], "event_type = purchase", 2000, "user_id", "csv")
