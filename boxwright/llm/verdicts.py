"""Whole rows meet narrow verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of verdicts up to which they are sent to the rows; above, Spark joins by its own choice and may shuffle both.
BROADCAST_BYTES = 32 << 20
#: Bytes of a verdict with its key, without what else it carries.
ROW_BYTES = 64


def few(stored: DataFrame, most: int = BROADCAST_BYTES, *, more: Column | None = None) -> DataFrame:
    """A stored table, marked for broadcast if its rows, and the further bytes that a column tells for each, show that it has at most ``most``."""
    size = F.sum((F.lit(ROW_BYTES) if more is None else more + ROW_BYTES).cast("long"))
    return F.broadcast(stored) if (stored.agg(size).first()[0] or 0) <= most else stored
