"""Measures used by many queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(column: str | Column) -> Column:
    """An exact decimal: sums of it do not depend on the order of rows."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def amount(column: str | Column = "l_extendedprice") -> Column:
    return F.sum(money(column)).cast("double")


def when_at(text: str) -> Column:
    """A time literal of the tables' type, which the optimizer folds and pushes down."""
    return F.lit(text).cast("timestamp_ntz")


def year(column: str) -> Column:
    return F.year(column).cast("long")


def hits(condition: Column) -> Column:
    """How many rows meet a condition."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")
