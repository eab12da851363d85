"""Name -> query, the counterpart of a table of named scan functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import changes, forecast, layout, scans, statistics, workloads
from ..streaming import changes as streams
from . import decision

MODULES = (decision, scans, changes, statistics, workloads, forecast, layout, streams)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
