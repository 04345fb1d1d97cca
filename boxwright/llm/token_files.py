"""Token ids in Parquet, readable in part.

A row is a document: ``doc_id``, ``part`` (its file's place in the order),
``local_start`` (ids before it in that part), ``n_tokens`` and the list column
``tokens``. Small columns use dictionaries or delta encoding, ``tokens`` a
dictionary (ids repeat; the vocabulary bounds it). Row groups and pages are of
set sizes and pages carry an index, so that a reader of lengths never touches
ids, and a reader of some documents touches only their pages.

Null texts are empty. Null ids come first, rows of one id stand side by side in
the order of their texts' hashes (equal rows in any), other columns are not
written. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm.memory import give_back, small_batches
from boxwright.llm.prefix import offsets
from boxwright.llm.tokens import encoder, slices

ROW = "part int, doc_id bigint, local_start bigint, n_tokens bigint, tokens array<int>"
#: Bytes of a row group and of a page.
GROUP_BYTES, PAGE_BYTES = 32 << 20, 256 << 10
#: Rows of a page at most.
PAGE_ROWS = 1000


def write_tokens(docs: DataFrame, path: str, spec: str, end_id: int, group_bytes: int = GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode whole texts and write them to ``path`` in ascending order of doc_id.

    The texts are dealt out by ranges of doc_id before they are encoded: the
    sampling that finds the ranges then reads but doesn't encode.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(spec), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, "text"):
                ids, lens = enc.encode(some.column("text"))
                n = lens + 1
                ends = np.cumsum(n)
                flat = np.full(int(ends[-1]), end_id, np.int32)
                inner = np.ones(len(flat), bool)
                inner[ends - 1] = False
                flat[inner] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), some.column("doc_id"), pa.array(start + ends - n), pa.array(n), lists], names=["part", "doc_id", "local_start", "n_tokens", "tokens"])
                start += int(ends[-1])
        give_back()

    small_batches(docs.sparkSession)
    order = ["doc_id", "_tie"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop("_tie")
    options = {
        "compression": "zstd",
        "parquet.block.size": group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#tokens.list.element": "true",
        "parquet.dictionary.page.size": 1 << 20,
    }
    dealt.mapInArrow(run, ROW).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(path)


def tokens_of(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """doc_id, n_tokens, tokens of some documents: row groups and pages without one of the ids are not read."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(ids)).select("doc_id", "n_tokens", "tokens")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens; reads no ids. Offsets have one row a part, so they are sent to each task."""
    rows = read_tokens(spark, path).select("part", "doc_id", "local_start", "n_tokens")
    return rows.join(F.broadcast(offsets(rows, "part", "n_tokens")), "part").select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """What the files say of each document: doc_id, start, n_tokens, ids_crc32."""
    rows = read_tokens(spark, path)
    before = F.broadcast(offsets(rows, "part", "n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = rows.join(before, "part").select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "tokens")
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
