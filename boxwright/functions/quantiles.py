"""Exact quantiles of large columns, without a buffer that grows with the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that an interval of values is counted in.
BINS = 1024


def ranked_values(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at some places (from 0) of a column in ascending order; nulls don't count.

    Selection by counting: the interval that holds a place is cut into equal parts, the rows of each are
    counted with their least and greatest value, and the part that holds the place is the next interval,
    until it has one value. The least and greatest fall into different parts, so every round gets nearer;
    doubles take six rounds or so. Each round is one scan; what comes back is the parts' counts.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    out: dict[int, float] = {}
    open_ = {(low, high): [(r, r) for r in sorted(set(ranks)) if 0 <= r < n]}  # interval: (place asked for, place within it)
    while open_ := {i: rs for i, rs in open_.items() if rs}:
        for (a, b), rs in [x for x in open_.items() if x[0][0] == x[0][1]]:
            out |= {r: a for r, _ in rs}
            del open_[a, b]
        if not open_:
            break
        intervals = sorted(open_)
        which = F.when(F.lit(False), F.lit(None).cast("int"))
        part = F.when(F.lit(False), F.lit(None).cast("int"))
        for k, (a, b) in enumerate(intervals):
            inside = (F.col("v") >= a) & (F.col("v") <= b)
            wide = math.isinf(b - a)  # halves, where the difference is no number
            at = F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * BINS) if wide else F.floor((F.col("v") - a) / (b - a) * BINS)
            which, part = which.when(inside, F.lit(k)), part.when(inside, F.least(at, F.lit(BINS - 1)).cast("int"))
        counted = values.select("v", which.alias("k"), part.alias("p")).filter("k is not null").groupBy("k", "p").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        following: dict[tuple[float, float], list[tuple[int, int]]] = {}
        for k, interval in enumerate(intervals):
            before, todo = 0, open_[interval]
            for x in sorted((r for r in counted if r["k"] == k), key=lambda r: r["p"]):
                mine = [(r, at - before) for r, at in todo if before <= at < before + x["n"]]
                if mine:
                    following.setdefault((x["low"], x["high"]), []).extend(mine)
                before += x["n"]
        open_ = following
    return out


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, between two values in proportion, as ``percentile`` has them; None where there is no value."""
    n = df.agg(F.count(column)).first()[0]
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * q for q in shares]
    at = ranked_values(df, column, [x for p in places for x in (math.floor(p), math.ceil(p))])
    return [at[math.floor(p)] if math.floor(p) == math.ceil(p) else (math.ceil(p) - p) * at[math.floor(p)] + (p - math.floor(p)) * at[math.ceil(p)] for p in places]
