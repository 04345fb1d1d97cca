"""Connected components of links, by star contraction on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.session import drop_path, scratch_path, shuffles_dropped


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a batch as links of each node to the least of its component in that batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        low = np.arange(len(nodes))
        while True:
            least = np.minimum(low[x], low[y])
            new = low.copy()
            np.minimum.at(new, low[x], least)
            np.minimum.at(new, low[y], least)
            new = new[new]
            if (new == low).all():
                break
            low = new
        out = np.flatnonzero(low != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[low[out]]), pa.array(nodes[out])], names=["a", "b"])


#: Links up to which callers may have them joined in one task: 16 bytes each.
FEW_LINKS = 200_000


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``local_stars`` of all batches together."""
    found = list(batches)
    if found:
        yield from local_stars(iter(pa.Table.from_batches(found).combine_chunks().to_batches()))


def connected_components(links: DataFrame, name: str = "components", stars: bool = False, few: int = 0) -> DataFrame:
    """(node, component) for every node that has a link; component is its least node.

    ``links`` has long columns a, b; ``stars`` says that ``local_stars`` made them. Rounds of large and small stars: each node
    passes its neighbours to the least node it sees, until only stars are left.
    Both steps aggregate a minimum, which is combined before the shuffle, so a
    node with very many neighbours costs no single task. Each round is written
    to the shared folder; only its counts come to the driver. If a count shows that there are
    no more than ``few`` links, one task joins them all and the rounds are saved.
    """
    spark = links.sparkSession

    def write(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, name)
        with shuffles_dropped(spark):
            df.write.parquet(path)
        return spark.read.schema("a bigint, b bigint").parquet(path), path

    def stats(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    edges = (edges if stars else edges.mapInArrow(local_stars, "a bigint, b bigint")).distinct()
    edges, path = write(edges)
    before = stats(edges)
    if before[0] <= few:
        many, many_path = edges, path
        edges, path = write(many.coalesce(1).mapInArrow(_whole, "a bigint, b bigint"))
        drop_path(spark, many_path)
        before = (0,)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("low").alias("a"), "b").filter("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(down, "b").select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        new, new_path = write(small)
        after = stats(new)
        drop_path(spark, path)
        edges, path = new, new_path
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
