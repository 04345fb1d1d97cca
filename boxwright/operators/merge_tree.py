"""How many clusters a spanning forest has at every height.

Clusters merge in the order of the forest's edges. The edges are taken in blocks of
heights: what earlier blocks have joined is one node with a size, so each block is a small
graph whose components are independent of each other, and in each of these the edges
are followed one by one. A block has a bounded number of edges; only a height that
more of them share is a larger one, and that is counted by its components as a whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.components import FEW_LINKS, connected_components
from boxwright.functions.quantiles import quantiles
from boxwright.session import cut

#: Edges of a block, and so of what one task follows.
BLOCK_EDGES = 100_000
EVENTS = "w double, gained bigint"


def _follow(edges: pd.DataFrame, least: int) -> pd.DataFrame:
    """Clusters gained (or lost) with each edge of one component, in order of height."""
    edges = edges.sort_values(["w", "ca", "cb"], kind="stable")
    up: dict[int, int] = {}
    size: dict[int, int] = {}
    for node, n in [*zip(edges["ca"], edges["na"], strict=True), *zip(edges["cb"], edges["nb"], strict=True)]:
        up[node], size[node] = node, n

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b, w in zip(edges["ca"], edges["cb"], edges["w"], strict=True):
        x, y = top(a), top(b)
        if x == y:
            continue
        gained = int(size[x] + size[y] >= least) - int(size[x] >= least) - int(size[y] >= least)
        if size[x] < size[y]:
            x, y = y, x
        up[y] = x
        size[x] += size[y]
        if gained:
            out.append((w, gained))
    return pd.DataFrame(out, columns=["w", "gained"]).astype({"w": "float64", "gained": "int64"})


def cluster_counts(forest: DataFrame, least: int, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """w, n: the clusters of ``least`` (2 or more) nodes once all edges (a, b, w) up to that height are in, for each height at which it changes."""
    n = forest.count()
    blocks = max(1, -(-n // block_edges))
    bounds = sorted(set(quantiles(forest, "w", [k / blocks for k in range(1, blocks)]))) if blocks > 1 else []
    block = F.lit(0)
    for b in bounds:
        block = block + (F.col("w") > b).cast("int")
    edges = cut(forest.select("a", "b", "w", block.alias("block")), "by-height")
    events, parts = None, None
    for k in range(len(bounds) + 1):
        mine = edges.filter(F.col("block") == k)
        if parts is None:
            mine = mine.select("w", F.col("a").alias("ca"), F.lit(1).cast("long").alias("na"), F.col("b").alias("cb"), F.lit(1).cast("long").alias("nb"))
        else:
            for x in "ab":
                mine = mine.join(parts.select(F.col("node").alias(x), F.col("part").alias(f"c{x}"), F.col("size").alias(f"n{x}")), x, "left")
            one = F.lit(1).cast("long")
            mine = mine.select("w", F.coalesce("ca", "a").alias("ca"), F.coalesce("na", one).alias("na"), F.coalesce("cb", "b").alias("cb"), F.coalesce("nb", one).alias("nb"))
        mine = cut(mine, "block")
        groups = cut(connected_components(mine.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "block-parts", few=FEW_LINKS), "block-parts")
        sizes = mine.select(F.col("ca").alias("node"), F.col("na").alias("n")).union(mine.select(F.col("cb"), F.col("nb"))).distinct()
        sized = cut(groups.join(sizes, "node"), "block-sizes")
        if mine.agg(F.count_distinct("w")).first()[0] > 1:
            of = groups.select(F.col("node").alias("ca"), "component")
            new = mine.join(of, "ca").groupBy("component").applyInPandas(lambda e: _follow(e, least), EVENTS)
        else:
            height = mine.agg(F.max("w")).first()[0]
            per = sized.groupBy("component").agg((F.sum("n") >= least).cast("long").alias("after"), F.count_if(F.col("n") >= least).alias("before"))
            new = per.select(F.lit(height).cast("double").alias("w"), (F.col("after") - F.col("before")).alias("gained")).filter("gained <> 0")
        new = cut(new, "events")
        events = new if events is None else events.union(new)
        if k < len(bounds):
            merged = sized.groupBy("component").agg(F.sum("n").alias("size"))
            now = sized.join(merged, "component").select(F.col("node").alias("part"), F.col("component").alias("_to"), "size")
            if parts is None:
                parts = cut(now.select(F.col("part").alias("node"), F.col("_to").alias("part"), "size"), "nodes")
            else:
                known = parts.join(now.withColumnRenamed("size", "_size"), "part", "left").select("node", F.coalesce("_to", "part").alias("part"), F.coalesce("_size", "size").alias("size"))
                fresh = now.join(parts.select(F.col("part")).distinct(), "part", "left_anti").select(F.col("part").alias("node"), F.col("_to").alias("part"), "size")
                parts = cut(known.union(fresh), "nodes")
    return _running(events.groupBy("w").agg(F.sum("gained").alias("gained")).filter("gained <> 0"))


def _running(events: DataFrame) -> DataFrame:
    """Running totals in order of height: within ranges, after the totals of the ranges before."""
    dealt = cut(events.repartitionByRange("w").withColumn("_part", F.spark_partition_id()), "ranges")
    before, total = [], 0
    for part, gained in sorted((r["_part"], r["g"]) for r in dealt.groupBy("_part").agg(F.sum("gained").alias("g")).collect()):
        before.append((part, total))
        total += gained
    offsets = events.sparkSession.createDataFrame(before or [(0, 0)], "_part int, _before bigint")
    inside = F.sum("gained").over(Window.partitionBy("_part").orderBy("w").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_in", inside).join(F.broadcast(offsets), "_part").select("w", (F.col("_before") + F.col("_in")).alias("n"))


def nearest_height(counts: DataFrame, forest: DataFrame, wanted: int, highest: float) -> float | None:
    """The height up to ``highest`` with the number of clusters nearest to the one wanted, the highest such; None if there is none.

    A number holds from where ``counts`` has it to the last edge before the next.
    """
    best = counts.filter(F.col("w") <= highest).agg(F.min_by("w", F.struct(F.abs(F.col("n") - wanted), -F.col("w"))).alias("w")).first()["w"]
    if best is None:
        return None
    following = counts.filter(F.col("w") > best).agg(F.min("w")).first()[0]
    edges = forest.filter(F.col("w") <= highest)
    return (edges if following is None else edges.filter(F.col("w") < following)).agg(F.max("w")).first()[0]
