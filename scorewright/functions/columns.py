"""Helpers on Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value evaluated once, wherever the optimizer moves or repeats the expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def once(udf):
    """A Python function whose result the optimizer neither repeats nor moves into another expression, such as a lambda."""
    return udf.asNondeterministic()
