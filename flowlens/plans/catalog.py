"""Every query of the library by name, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FAMILIES = ["q_features", "q_labels", "q_flow", "q_graph", "q_metrics", "q_views", "q_learn", "q_discovery", "q_rules", "q_more", "q_sources", "q_cases", "q_protocol", "q_logs"]

for _family in FAMILIES:
    _module = import_module(f"flowlens.plans.{_family}")
    assert not QUERIES.keys() & _module.QUERIES.keys(), f"{_family} repeats a name"
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
