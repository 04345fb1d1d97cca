"""Running totals over an order, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def offsets(parts: DataFrame, part: str, total: str, name: str = "offset") -> DataFrame:
    """(part, offset): what all parts before each hold. One row a partition goes in."""
    sums = parts.groupBy(part).agg(F.sum(total).alias("_sum"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias(name))

