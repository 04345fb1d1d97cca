"""Stored rankings, of which any page is read without sorting again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.session import drop_path, written


class Ranking:
    """Rows in an order, dealt out by range into parts, each stored in order with its rows numbered from 0.

    The numbers of rows of the parts (one a part) tell in which part any rank lies, so a page
    reads the one or two parts that it lies in, whatever the length of the ranking.
    """

    def __init__(self, df: DataFrame, *order: Column | str, name: str = "ranking"):
        columns = df.columns
        dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at"))
        placed = dealt.select(*columns, F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in"))
        self.spark, self.columns = df.sparkSession, columns
        # One task writes one part; in a part, rows are found by the least and greatest number of each page of the file.
        self._rows, self._path = written(placed, name, **{"parquet.page.row.count.limit": "2000"})
        self._before, self.size = [], 0
        for part, n in sorted((r["_part"], r["n"]) for r in self._rows.groupBy("_part").agg(F.count("*").alias("n")).collect()):
            self._before.append((part, self.size, n))
            self.size += n

    def page(self, offset: int, size: int) -> DataFrame:
        """Rows from ``offset`` on with their rank from 1, in order; fewer at the end, none beyond it."""
        wanted: Column = F.lit(False)
        before: Column = F.lit(None).cast("bigint")
        for part, first, n in self._before:
            low, high = max(0, offset - first), min(n, offset + size - first)
            if low < high:
                wanted = wanted | ((F.col("_part") == part) & (F.col("_in") >= low) & (F.col("_in") < high))
                before = F.coalesce(F.when(F.col("_part") == part, F.lit(first).cast("bigint")), before)
        found = self._rows.filter(wanted)
        return found.select(*self.columns, (before + F.col("_in") + 1).alias("rank")).orderBy("rank")

    def last(self, size: int) -> DataFrame:
        return self.page((max(self.size, 1) - 1) // size * size, size)

    def drop(self) -> None:
        drop_path(self.spark, self._path)


def rows_of(page: DataFrame, df: DataFrame, key: str = "roi_index") -> DataFrame:
    """Rows of a table for a page of a ranking, in its order; the page, being of the size asked for, goes to each task."""
    extra = [c for c in page.columns if c not in df.columns or c == key]
    return df.join(F.broadcast(page.select(*extra)), key).orderBy("rank")
