"""Predicates of the federation's expression language; any boolean Column works too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def eq(col: str | Column, value) -> Column:
    return _col(col) == F.lit(value)


def neq(col: str | Column, value) -> Column:
    """Unknown for nulls, as in SQL."""
    return _col(col) != F.lit(value)


def contains(col: str | Column, part: str) -> Column:
    """Case-sensitive substring; ``%`` and ``_`` are ordinary characters."""
    return F.contains(_col(col), F.lit(part))
