"""Chains of comparisons with constants: all of some, any of others, joined by AND or OR."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


@dataclass(frozen=True)
class Compare:
    """A column against a constant.  An absent (null) cell does not meet it, so it is never null."""

    column: str
    op: str
    value: object

    def build(self) -> Column:
        # Both terms can be pushed into a scan; together they are false for null.
        return COMPARE[self.op](F.col(self.column), F.lit(self.value)) & F.col(self.column).isNotNull()


@dataclass(frozen=True)
class Chain:
    """All of ``every`` joined with any of ``some``; an empty list takes no part.

    A null cell fails in ``every`` and is passed over in ``some``: no comparison is null, which
    gives that even when both are joined by OR or the whole is negated.
    """

    every: list[Compare] = field(default_factory=list)
    some: list[Compare] = field(default_factory=list)
    joined_by_and: bool = True

    def build(self) -> Column:
        parts = []
        if self.every:
            parts.append(reduce(operator.and_, (c.build() for c in self.every)))
        if self.some:
            parts.append(reduce(operator.or_, (c.build() for c in self.some)))
        if not parts:
            return F.lit(True)
        return reduce(operator.and_ if self.joined_by_and else operator.or_, parts)


def between(column: str, low: object, high: object) -> Column:
    """A half-open range; on strings also the way to ask for a prefix."""
    return (F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high))


def ranges(column: str, bounds: list[tuple[object, object]]) -> Column:
    """Any of several closed ranges; a row in two of them comes once."""
    return reduce(operator.or_, (F.col(column).between(lo, hi) for lo, hi in bounds))
