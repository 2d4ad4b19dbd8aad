"""Vectors as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value computed once a row: where lambdas use it, it would be computed for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))
