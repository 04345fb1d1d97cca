"""Documents coded against dictionaries of bounded chunks.

A word-level join that shuffles each occurrence moves more bytes than the
corpus has. Here every task codes its documents chunk by chunk (some megabytes
of text each): a chunk's distinct words are asked about once, shard by shard,
and its documents travel as small integers that point into them. The answers
meet the coded documents chunk by chunk, so no step holds more than a chunk or
a shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm.memory import small_batches
from boxwright.session import drop_path, scratch_path

DOC, OWN, ASK = 0, 1, 2
CODED = "chunk string, kind tinyint, part int, doc_ids array<bigint>, payload binary"
SCHEMA = pa.schema([("chunk", pa.string()), ("kind", pa.int8()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
DOCS_IN_ROW = 2000


def blob(*arrays: tuple[np.ndarray, int], raw: bytes = b"", level: int = 3) -> bytes:
    """Arrays of unsigned integers, so many bytes of each kept, byte plane by byte plane; then raw bytes. Compressed."""
    planes = [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for a, w in arrays]
    return zstandard.ZstdCompressor(level=level).compress(np.array([len(a) for a, _ in arrays], "<u8").tobytes() + b"".join(planes) + raw)


def unblob(data: bytes, *widths: int) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * len(widths), []
    for n, w in zip(np.frombuffer(data, "<u8", len(widths)).tolist(), widths, strict=True):
        a = np.zeros((n, 8), np.uint8)
        a[:, :w] = np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T
        out.append(a.reshape(-1).view("<u8"))
        at += n * w
    return out, data[at:]


def rows(chunk: str, kind: int, parts: list[int], ids: list, payloads: list[bytes]) -> pa.RecordBatch:
    """Rows of CODED."""
    n = len(payloads)
    return pa.RecordBatch.from_arrays([pa.array([chunk] * n), pa.array([kind] * n, pa.int8()), pa.array(parts, pa.int32()), pa.array(ids, SCHEMA.field("doc_ids").type), pa.array(payloads, pa.binary())], schema=SCHEMA)


def code_documents(docs: DataFrame, split: Callable[[], Callable[[str], list]], ask: Callable[[list, list[np.ndarray], list], Iterator[tuple[int, bytes]]], name: str, chunk_chars: int) -> Coded:
    """Table of chunks, written to the shared folder: rows of CODED.

    ``split()`` gives the function that cuts a text. ``ask`` makes blobs for
    shards from a chunk's ids, codes (which it may change) and words. Chunk
    names are drawn at random; as the table is committed once, a lost executor
    can't change them for later readers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_text = split()
        code: dict = {}
        ids: list = []
        coded: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = uuid.uuid4().hex
            blobs = list(ask(ids, coded, list(code)))
            for i in range(0, len(ids), DOCS_IN_ROW):
                some = coded[i : i + DOCS_IN_ROW]
                yield rows(chunk, DOC, [i // DOCS_IN_ROW], [ids[i : i + DOCS_IN_ROW]], [blob((np.array([len(c) for c in some]), 4), (np.concatenate(some), 4))])
            for i in range(0, len(blobs), 16):
                some = blobs[i : i + 16]
                for kind in (OWN, ASK):
                    of_kind = [(part, x) for part, x in some if (part >= 0) == (kind == ASK)]
                    if of_kind:
                        yield rows(chunk, kind, [part for part, _ in of_kind], [None] * len(of_kind), [x for _, x in of_kind])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = cut_text(text) if text else []
                n = len(code)
                for p in set(parts).difference(code):
                    code[p] = n
                    n += 1
                ids.append(doc_id)
                coded.append(np.fromiter(map(code.__getitem__, parts), np.uint32, len(parts)))
                size += len(text or "")
                if size >= chunk_chars:
                    yield from flush()
                    code, ids, coded, size = {}, [], [], 0
        if ids:
            yield from flush()

    spark = docs.sparkSession
    small_batches(spark)
    path = scratch_path(spark, name)
    docs.select("doc_id", "text").mapInArrow(run, CODED).write.partitionBy("kind").option("compression", "none").parquet(path)
    return Coded(spark, path)


class Coded:
    """The written table of chunks: documents, what a chunk keeps for itself (parts below 0), and what it asks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _kind(self, kind: int, *columns: str) -> DataFrame:
        return self.spark.read.schema(CODED).parquet(self.path).filter(F.col("kind") == kind).select(*columns)

    def documents(self) -> DataFrame:
        return self._kind(DOC, "chunk", "part", "doc_ids", "payload")

    def own(self) -> DataFrame:
        return self._kind(OWN, "chunk", "part", "payload")

    def asked(self) -> DataFrame:
        return self._kind(ASK, "chunk", "part", "payload")

    def drop_asked(self) -> None:
        """Once the answers are written, nothing reads the questions again."""
        drop_path(self.spark, f"{self.path}/kind={ASK}")


def documents_of(table: pd.DataFrame) -> tuple[list[int | None], list[np.ndarray]]:
    """Ids and codes of a chunk's documents."""
    ids: list[int | None] = []
    codes: list[np.ndarray] = []
    for of, payload in zip(table["doc_ids"], table["payload"], strict=True):
        (lens, flat), _ = unblob(payload, 4, 4)
        ids += [None if x is None or x != x else int(x) for x in of]
        codes += np.split(flat, np.cumsum(lens.astype(np.int64))[:-1]) if len(lens) else []
    return ids, codes
