"""Rankings in embedding space, and filling of missing vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions import labels
from boxwright.operators.mutations import bulk_update
from boxwright.session import cut, drop_path, written
from boxwright.store import Store


def mean_vector(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Element-wise mean of a vector column, of all rows or by groups, combined before the shuffle; no row, no mean."""
    rows = df.filter(F.col(column).isNotNull()).withColumn("_v", array_to_vector(column))
    found = rows.groupBy(*(by or [F.lit(0).alias("_all")])).agg(Summarizer.mean(F.col("_v")).alias("mean"), F.count("*").alias("n"))
    return found.withColumn("mean", vector_to_array("mean")).drop("_all")


def check_lengths(df: DataFrame, column: str) -> None:
    """Vectors of one column must have one length."""
    got = df.filter(F.col(column).isNotNull()).agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if got[0] != got[1]:
        raise ValueError(f"{column} has vectors of {got[0]} to {got[1]} numbers")


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, straight from its buffer."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1 if len(vectors) else 1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1])), pa.int32()), pa.array(x.ravel()))


def unit(column: str, centre: list[float] | None = None) -> Column:
    """Vectors less a centre, at unit length; a zero vector stays one."""
    c = np.array(centre if centre is not None else 0.0)

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        x = _matrix(v) - c
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return _lists(x / np.where(n == 0, 1, n))

    return run(column)


def dot(a: str, b: str) -> Column:
    """Inner product of two vector columns."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(np.einsum("ij,ij->i", _matrix(x), _matrix(y)))

    return run(a, b)


def cosine_from(column: str, centre: list[float], to: list[float] | str) -> Column:
    """Cosine of vectors less a centre to a unit vector or a column of such; null where either is."""
    c, fixed = np.array(centre), None if isinstance(to, str) else np.array(to)

    def score(v: pa.Array, r: np.ndarray) -> np.ndarray:
        x = _matrix(v) - c
        n = np.linalg.norm(x, axis=1)
        return (x * r).sum(1) / np.where(n == 0, 1, n) if r.ndim == 2 else x @ r / np.where(n == 0, 1, n)

    if fixed is not None:

        @F.arrow_udf("double")
        def to_one(v: pa.Array) -> pa.Array:
            return pa.array(score(v, fixed))

        return to_one(column)

    @F.arrow_udf("double")
    def to_each(v: pa.Array, r: pa.Array) -> pa.Array:
        some = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False) & r.is_valid().to_numpy(zero_copy_only=False))
        out = np.full(len(v), np.nan)
        if len(some):
            out[some] = score(v.take(pa.array(some)), _matrix(r.take(pa.array(some))))
        return pa.array(out, mask=~np.isin(np.arange(len(v)), some))

    return to_each(column, to)


def similar_scores(df: DataFrame, roi_index: int, label: str | None = None, mode: str = "effective", column: str = "embedding", ids: DataFrame | None = None, **filters) -> DataFrame | None:
    """roi_index, score of the pool, in no order; None if the reference has no vector, no rows if the pool has none.

    The reference needn't be in the pool. One pass finds it and the pool's mean, which alone
    reach the driver; a second one scores. Vectors of several lengths are an error.
    """
    here = labels.pool_filter(label, mode, **filters)
    rows = df.filter(F.col(column).isNotNull())
    if ids is not None:
        listed = ids.select(F.col("roi_index").alias("_id")).distinct()
        rows = rows.join(listed, F.col("roi_index") == F.col("_id"), "left")
        here = here & F.col("_id").isNotNull()
    rows = rows.select("roi_index", column, F.coalesce(here, F.lit(False)).alias("_in"))
    ref = F.first(F.when(F.col("roi_index") == roi_index, F.col(column)), ignorenulls=True).alias("ref")
    try:
        found = {r["_in"]: r for r in rows.groupBy("_in").agg(Summarizer.mean(array_to_vector(column)).alias("mean"), ref).withColumn("mean", vector_to_array("mean")).collect()}
    except (PySparkException, Py4JJavaError):
        check_lengths(rows, column)
        raise
    refs = [r["ref"] for r in found.values() if r["ref"] is not None]
    if not refs:
        return None
    pool = rows.filter("_in")
    if True not in found:
        return pool.select("roi_index", F.lit(0.0).alias("score"))
    mean = found[True]["mean"]
    r = np.array(refs[0], np.float64) - np.array(mean)
    return pool.select("roi_index", cosine_from(column, mean, (r / (np.linalg.norm(r) or 1.0)).tolist()).alias("score"))


def similar(df: DataFrame, roi_index: int, label: str | None = None, mode: str = "effective", column: str = "embedding", ids: DataFrame | None = None, **filters) -> DataFrame | None:
    """``similar_scores``, most alike first. Scores are stored before they are sorted, so vectors are not scored twice."""
    scores = similar_scores(df, roi_index, label, mode, column, ids, **filters)
    return None if scores is None else cut(scores, "scores").orderBy(F.desc("score"), "roi_index")


def outlier_scores(df: DataFrame, column: str = "embedding", **filters) -> DataFrame:
    """roi_index, label, score of the pool, in no order: how much each row looks like its label ('' for none); null without a vector.

    Vectors of several lengths are an error.
    """
    pool = df.filter(labels.pool_filter(**filters)).select("roi_index", F.coalesce(labels.review_label(), F.lit("")).alias("label"), column)
    try:
        mean = mean_vector(pool, column).first()
    except (PySparkException, Py4JJavaError):
        check_lengths(pool, column)
        raise
    if mean is None:
        return pool.select("roi_index", "label", F.lit(None).cast("double").alias("score"))
    units = pool.filter(F.col(column).isNotNull()).select("label", unit(column, mean["mean"]).alias("u"))
    centroids = cut(mean_vector(units, "u", "label").select("label", unit("mean").alias("c")), "centroids")
    return pool.join(centroids, "label", "left").select("roi_index", "label", cosine_from(column, mean["mean"], "c").alias("score"))


def outliers(df: DataFrame, column: str = "embedding", **filters) -> DataFrame:
    """``outlier_scores`` label by label, least alike first within each; rows without a vector come last, without a score."""
    return cut(outlier_scores(df, column, **filters), "scores").orderBy(F.lower("label"), F.col("score").asc_nulls_last(), "roi_index")


def _scored(todo: DataFrame, scorer: Callable[[pd.DataFrame], list], column: str) -> DataFrame:
    """id and vector of each row, null for a bad item; a batch that fails is tried item by item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                vectors = list(scorer(pdf))
            except Exception:
                vectors = []
                for i in range(len(pdf)):
                    try:
                        vectors += list(scorer(pdf.iloc[i : i + 1]))
                    except Exception:
                        vectors.append(None)
            yield pd.DataFrame({"id": pdf["id"], column: vectors})

    return todo.mapInPandas(run, f"id int, {column} array<float>")


def _counts(made: DataFrame, column: str) -> DataFrame:
    return made.agg(F.count(column).alias("n_filled"), F.count_if(F.col(column).isNull()).alias("n_failed"))


def fill(df: DataFrame, scorer: Callable[[pd.DataFrame], list], inputs: list[str], column: str = "embedding", force: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors for rows that have none (all with ``force``), by a caller's scorer: batch -> vectors.

    Bad items stay null. What the scorer made is stored, so each row is scored once. Returns the
    table and (n_filled, n_failed).
    """
    todo = df if force else df.filter(F.col(column).isNull())
    todo = todo.select("id", *inputs)
    if limit is not None:
        todo = todo.orderBy("id").limit(limit)
    made = cut(_scored(todo, scorer, column), "vectors")
    return bulk_update(df, made.filter(F.col(column).isNotNull()), "id"), _counts(made, column)


def fill_store(store: Store, scorer: Callable[[pd.DataFrame], list], inputs: list[str], column: str = "embedding", force: bool = False, table: str = "predictions", batch: int = 100_000) -> tuple[int, int]:
    """``fill`` of a stored table, a range of ids at a time; (filled, failed).

    The vectors of each range are committed when they are made, so a run that is stopped loses one range at
    most, and the next one takes up what is missing. Labels and boxes are not written again.
    """
    if store.column_group(table, column) is None:
        store.add_column(table, column, "array<float>", "vectors")
    rows = store.read(table, *store.groups_of(table, [column, *inputs]))
    todo = rows if force else rows.filter(F.col(column).isNull())
    filled = failed = 0
    for r in sorted(todo.groupBy(F.floor(F.col("id") / batch).alias("block")).agg(F.count("*").alias("n")).collect()):
        mine = todo.filter((F.col("id") >= r["block"] * batch) & (F.col("id") < (r["block"] + 1) * batch)).select("id", *inputs)
        made, path = written(_scored(mine, scorer, column), "vectors")
        store.change(table, made.filter(F.col(column).isNotNull()))
        n = _counts(made, column).first()
        filled, failed = filled + n["n_filled"], failed + n["n_failed"]
        drop_path(store.spark, path)
    store.compact(table)
    return filled, failed
