"""Keeping an expensive column from being computed twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def evaluated_once(column: Column) -> Column:
    """The same values, as a column that is produced by a generator of one row per row.

    A filter on a computed column is otherwise pushed below the projection together with a copy of
    the expression, so a long chain of rules or a model would run a second time. Filters on the
    generated column stay above it; those on other columns still reach the scan. A projection
    takes one such column.
    """
    return F.explode(F.array(column))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]
