"""Session-level helpers: the shared scratch folder and cutting of lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: ContextVar[list[str] | None] = ContextVar("scratch paths of the innermost `cleared`", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as the session names it.

    ``spark.checkpoint.dir`` wins. Where it is unset, a temporary folder is made
    and stored there, but on one machine only: a cluster must name a shared one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when the write that made them ends, not at some later garbage collection.

    For tables that are written once and read from there: nothing reads the
    shuffle again. Files lost while the write runs are made anew as ever.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; the table as read back, and its path for ``drop_path``.

    Everything downstream starts from the committed files, so a lost executor
    re-reads them instead of recomputing, and rows that depend on the task
    that made them (chunk names, say) cannot change between two readers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``written`` for a table that is part of a result."""
    return written(df, name, **options)[0]


def never_sent(df: DataFrame) -> DataFrame:
    """One side of a join of two tables of a row a box: joined by sorting, whatever size Spark takes it to have.

    Spark goes by the bytes of the files, and a stored table of equal vectors or running numbers has far fewer
    than its rows; it would be collected by the driver and sent to every executor.
    """
    return df.hint("merge")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Within, a ``cut`` whose tables go at the end."""
    paths: list[str] = []

    def own(df: DataFrame, name: str, **options: str) -> DataFrame:
        out, path = written(df, name, **options)
        paths.append(path)
        return out

    try:
        yield own
    finally:
        for path in paths:
            drop_path(spark, path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """At the end every scratch table that was made within goes, whichever operator made it.

    What operators return reads such tables, so write or collect it inside. Of nested ones each
    removes its own. Batches of a stream run in a thread of their own and are not covered.
    """
    made: list[str] = []
    before = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(before)
        for path in made:
            drop_path(spark, path)


def saved(spark: SparkSession, make: Callable[[], DataFrame], path: str, **options: str) -> DataFrame:
    """Write what ``make`` returns to ``path``, and nothing else stays in the shared folder; the table as read back."""
    with cleared(spark), shuffles_dropped(spark):
        df = make()
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through the file system that holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
