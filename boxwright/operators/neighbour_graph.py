"""Nearest neighbours beyond the square: an inverted file whose recall is measured first.

Rows lie in cells about centroids, and each looks only into the cells nearest to it. How
many cells it takes is not guessed: for a bounded set of rows the true neighbours are found
among all rows, and the cells that these lie in tell what share of them any number of cells
would find. Equal vectors are one row in the search and get their copies back at the end, so
a vector that very many rows share is no large cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.session import cut

#: Rows that a cell has on average; cells at most, so that centroids stay a small table; rows a centroid is fitted on.
CELL_ROWS, CELLS, FITTED = 1000, 4096, 16
#: Rows whose true neighbours are looked for among all; rows of a side that one task holds.
ASKED, SIDE = 400, 20_000
FIT_ROUNDS = 6
#: Cells are searched in groups of about so many rows, and in so many groups at least.
GROUP_ROWS, GROUPS = 50_000, 8


def _sample(rows: DataFrame, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of the n rows of the least hashes."""
    got = rows.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(n).select("rep", "u").toPandas()
    return got["rep"].to_numpy(np.int64), np.stack(got["u"].to_numpy()) if len(got) else np.zeros((0, 1))


def _centroids(x: np.ndarray, cells: int) -> np.ndarray:
    """A few rounds of k-means on a bounded sample, from evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        near = np.concatenate([(x[i : i + 4096] @ c.T - (c**2).sum(1) / 2).argmax(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _order(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cells of each row, the nearest first."""
    return np.argsort((c**2).sum(1) / 2 - x @ c.T, axis=1, kind="stable")


def vector_rows(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def true_neighbours(rows: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """a, b, d: the k nearest of a stated set of rows, among all rows (rep, u). Each task keeps k for each."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from boxwright.operators.clustering import _nearest

        mine, asked = shared.value
        for batch in batches:
            b = batch.column("rep").to_numpy().astype(np.int64)
            for of, who, d in _nearest(mine, asked, b, vector_rows(batch.column("u")), k):
                some = np.isfinite(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of, some.sum(1))), pa.array(who[some]), pa.array(d[some])], names=["a", "b", "d"])

    return _best(rows.select("rep", "u").mapInArrow(run, "a bigint, b bigint, d double"), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return found.withColumn("_r", nth).filter(F.col("_r") <= k).drop("_r")


def _cells_needed(rows: DataFrame, c: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """The least number of cells to look into that finds the wanted share of true neighbours, and that share."""
    ids, x = _sample(rows, ASKED, 2)
    true = true_neighbours(rows, ids, x, k)
    theirs = true.join(rows.select(F.col("rep").alias("b"), "home"), "b").select("a", "home").toPandas()
    place = np.argsort(_order(x, c), axis=1)  # of each cell in each row's order
    at = {a: i for i, a in enumerate(ids.tolist())}
    ranks = np.array([place[at[a], h] for a, h in zip(theirs["a"], theirs["home"], strict=True)], int)
    if not len(ranks):
        return 1, 1.0
    share = np.cumsum(np.bincount(ranks, minlength=len(c))) / len(ranks)
    p = int(np.argmax(share >= recall)) + 1
    return p, float(share[p - 1])


def different(units: DataFrame, k: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """One row (rep, u) of each set of equal vectors (roi_index, u), the least; and what ``with_copies`` needs, None if no two are equal."""
    key = F.array(F.xxhash64("u"), F.xxhash64(F.lit(1), "u"))
    keyed = units.select("roi_index", key.alias("h"))
    low = lambda c: F.slice(F.sort_array(c), 1, k + 1)
    some = keyed.groupBy("h", F.pmod(F.xxhash64("roi_index"), F.lit(1024)).alias("_salt")).agg(low(F.collect_list("roi_index")).alias("low"), F.count("*").alias("n"))
    groups = cut(some.groupBy("h").agg(low(F.flatten(F.collect_list("low"))).alias("low"), F.sum("n").alias("n")), "equal")
    if groups.filter("n > 1").isEmpty():
        return units.select(F.col("roi_index").cast("long").alias("rep"), "u"), None
    reps = units.join(groups.select(F.get("low", F.lit(0)).alias("roi_index")), "roi_index").select(F.col("roi_index").cast("long").alias("rep"), "u")
    return reps, (keyed, groups)


def with_copies(near: DataFrame, copies: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """The k nearest of every row, from those (a, b, d) of one row of each set of equal vectors."""
    keyed, groups = copies
    sets = groups.select(F.get("low", F.lit(0)).cast("long").alias("b"), F.col("low").cast("array<bigint>").alias("low"))
    wide = near.join(sets, "b").select("a", F.explode("low").alias("b"), "d")
    own = sets.select(F.col("b").alias("a"), F.explode("low").alias("b"), F.lit(0.0).alias("d"))
    lists = _best(wide.union(own), k + 1)
    members = keyed.join(groups.select("h", F.get("low", F.lit(0)).cast("long").alias("a")), "h").select("a", F.col("roi_index").cast("long").alias("_of"))
    every = members.join(lists, "a").filter("_of <> b").select(F.col("_of").alias("a"), "b", "d")
    return _best(every, k)


def near_graph(units: DataFrame, k: int, recall: float = 0.95, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, float]:
    """(a, b, d) of each row's k nearest (roi_index, u), most of them true ones, and the share measured.

    What is shuffled is rows x groups of cells, not cells. The work is rows x cells looked into x rows of a cell, so it grows with the rows, up to CELLS x ``cell_rows`` of them.
    """
    from boxwright.operators.clustering import _nearest

    spark = units.sparkSession
    reps, copies = different(units, k)
    reps = cut(reps, "different")
    n = reps.count()
    cells = max(1, min(CELLS, n // cell_rows))
    _, x = _sample(reps, cells * FITTED, 1)
    c = _centroids(x, cells)
    shared = spark.sparkContext.broadcast(c)

    def looked(p: int):
        @F.arrow_udf("array<int>")
        def run(v: pa.Array) -> pa.Array:
            order = _order(vector_rows(v), shared.value)[:, :p].astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1]), pa.int32()), pa.array(order.ravel()))

        return run("u")

    placed = cut(reps.withColumn("home", F.get(looked(1), F.lit(0))), "placed")
    p, share = _cells_needed(placed, c, k, recall)
    per = max(1, -(-cells // min(cells, max(GROUPS, -(-n // GROUP_ROWS)))))  # cells of a group
    group_of = lambda c: F.floor(c / per).cast("int")
    homes = placed.withColumn("group", group_of(F.col("home")))
    sizes = homes.groupBy("group").agg(F.count("*").alias("n"))
    # A row goes once to each group of cells that it looks into, with the cells' numbers.
    listed = placed.select("rep", "u", looked(p).alias("_cells"))
    asks = listed.select("rep", "u", "_cells", F.explode(F.array_distinct(F.transform("_cells", group_of))).alias("group"))
    asks = asks.select("rep", "u", "group", F.filter("_cells", lambda c: group_of(c) == F.col("group")).alias("cells"))
    parts = lambda m, most: F.ceil(m / most).cast("int")
    asked = asks.groupBy("group").agg(F.count("*").alias("m"))
    plan = F.broadcast(cut(sizes.join(asked, "group").select("group", parts(F.col("n"), 2 * GROUP_ROWS).alias("sides"), parts(F.col("m"), SIDE).alias("asking")), "groups"))
    deal = lambda of: F.pmod(F.xxhash64("rep", F.lit(3)), F.col(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    a = asks.join(plan, "group").withColumns({"pa": deal("asking"), "pb": all_of("sides")}).select("group", "pa", "pb", "rep", "u", "cells")
    b = homes.join(plan, "group").withColumns({"pb": deal("sides"), "pa": all_of("asking")}).select(*(F.col(c).alias(f"b_{c}") for c in ("group", "pa", "pb", "rep", "u", "home")))

    def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        ids = x["rep"].to_numpy(np.int64)
        best, who = np.full((len(x), k), np.inf), np.full((len(x), k), -1, np.int64)
        if len(x) and len(y):
            mine, theirs = (np.stack(v.to_numpy()).astype(np.float64) for v in (x["u"], y["b_u"]))
            home, others = y["b_home"].to_numpy(), y["b_rep"].to_numpy(np.int64)
            row = np.repeat(np.arange(len(x)), [len(c) for c in x["cells"]])
            cell = np.concatenate(x["cells"].to_numpy())
            for c in np.unique(cell):
                at, there = row[cell == c], np.flatnonzero(home == c)
                begin = 0
                for of, found, d in _nearest(ids[at], mine[at], others[there], theirs[there], k):
                    some = at[begin : begin + len(of)]
                    begin += len(of)
                    both, names = np.concatenate([best[some], d], axis=1), np.concatenate([who[some], found], axis=1)
                    order = np.lexsort((names, both), axis=1)[:, :k]
                    best[some], who[some] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        fine = np.isfinite(best)
        return pd.DataFrame({"a": np.repeat(ids, fine.sum(1)), "b": who[fine], "d": best[fine]})

    near = a.groupBy("group", "pa", "pb").cogroup(b.groupBy("b_group", "b_pa", "b_pb")).applyInPandas(search, "a bigint, b bigint, d double")
    near = _best(near, k)
    return near if copies is None else with_copies(near, copies, k), share
