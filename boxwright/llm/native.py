"""Small helpers for operators written with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def renamed(df: DataFrame, *used: str) -> DataFrame:
    """A table whose columns but those used are numbered, so that no name of an operator's own can clash with one.

    ``toDF(*names)`` gives them back at the end.
    """
    return df.toDF(*(c if c in used else f"c{i}" for i, c in enumerate(df.columns)))
