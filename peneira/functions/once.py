"""Evaluate a costly expression once where it is used several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable, so it is evaluated once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Like ``withColumns``, but through a generator of one row.

    The optimizer neither copies these expressions into later ones nor pushes filters on
    them below, so each is evaluated once per row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
