"""Evaluate a value once, however often an expression uses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``. A lambda that names an outer expression computes it per element;
    here it names a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
