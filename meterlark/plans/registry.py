"""Every registered query of the usage and quota engine, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterlark.plans import collector_queries, current_queries, ledger_queries, presentation_queries, source_queries, usage_queries, window_queries
from meterlark.plans.oracles import ORACLES

_MORE = (source_queries, presentation_queries, window_queries, collector_queries, current_queries, ledger_queries)

FLAGSHIP = "windows_current_full"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = dict(usage_queries.QUERIES)
    for module in _MORE:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(ORACLES)
    for module in _MORE:
        found |= module.ORACLES
    return found
