"""BPE encoding and decoding by a distinct-word table.

Words are the stretches of a text between borders that no pre-token crosses.
Chunks of documents send their distinct words out once, to the shard that owns
each; there every distinct word of the corpus is encoded once; the ids go back
to the positions of the words in their chunk, and each document's ids are
joined from them. The table is read twice, for its words and for the coded
documents, which costs less disk than keeping both, so it must be a stored one.
A chunk is named by its partition, its place there and the hash of its rows: equal
rows in two chunks stay apart, and a table that reads otherwise the second time
is an error. Decoding looks every id up in the id-to-piece table, which the
vocabulary bounds (50,257 rows), and joins the pieces.

Null and empty texts have no ids. Null ids and repeated rows stay as they are,
one output row a row. A lone special token in a text becomes its id, as in the
library. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from boxwright.llm import chunks
from boxwright.llm.memory import give_back, small_batches
from boxwright.llm.tokens import encoder, pieces_by_id

CHUNK_CHARS = 12_000_000


def _in_order(words: Iterable[str], n_shards: int) -> tuple[list[bytes], list[int]]:
    """A chunk's words by shard and spelling, and where each shard ends. Their codes are their places."""
    shards: list[list[bytes]] = [[] for _ in range(n_shards)]
    for w in words:
        raw = w.encode()
        shards[zlib.crc32(raw) % n_shards].append(raw)
    for some in shards:
        some.sort()
    return [w for some in shards for w in some], np.cumsum([len(some) for some in shards]).tolist()


def _chunk_pass(spec: str, n_shards: int, chunk_chars: int, asking: bool):
    """Documents -> chunks, either what they ask of the shards or their coded documents.

    A chunk's name is its partition, its number there and the hash of its rows: both passes must see the same chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = encoder(spec).stretches
        code: dict[str, int] = {}
        ids: list = []
        coded: list[np.ndarray] = []
        partition, n_chunk, name = TaskContext.get().partitionId(), 0, hashlib.blake2b(digest_size=12)

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = f"{partition}-{n_chunk}-{name.hexdigest()}"
            words, ends = _in_order(code, n_shards)
            if asking:
                for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                    some = words[a:b]
                    yield chunks.rows(chunk, chunks.ASK, [k], [None], [chunks.blob((np.array([len(w) for w in some], np.int64), 3), raw=b"".join(some))])
                return
            place = {w: i for i, w in enumerate(words)}
            rank = np.fromiter((place[w.encode()] for w in code), np.uint32, len(code))
            for i in range(0, len(ids), chunks.DOCS_IN_ROW):
                some = coded[i : i + chunks.DOCS_IN_ROW]
                yield chunks.rows(chunk, chunks.DOC, [i // chunks.DOCS_IN_ROW], [ids[i : i + chunks.DOCS_IN_ROW]], [chunks.blob((np.array([len(c) for c in some]), 4), (rank[np.concatenate(some)], 4))])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = split(text) if text else []
                name.update(f"{doc_id} {len(parts)} ".encode() + (text or "").encode())
                n = len(code)
                for p in set(parts).difference(code):
                    code[p] = n
                    n += 1
                ids.append(doc_id)
                if not asking:
                    coded.append(np.fromiter(map(code.__getitem__, parts), np.uint32, len(parts)))
                size += len(text or "")
                if size >= chunk_chars:
                    yield from flush()
                    code, ids, coded, size, n_chunk, name = {}, [], [], 0, n_chunk + 1, hashlib.blake2b(digest_size=12)
        if ids:
            yield from flush()
        code, ids, coded = {}, [], []
        give_back()

    return run


def _cut_up(lens: np.ndarray, data: bytes) -> list[bytes]:
    ends = np.cumsum(lens.astype(np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _answer(spec: str):
    """A shard: each of its distinct words is encoded once, and every chunk that asked gets its ids."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        of_chunk = []
        for payload in rows["payload"]:
            (lens,), data = chunks.unblob(payload, 3)
            of_chunk.append(_cut_up(lens, data))
        words = list(dict.fromkeys(w for some in of_chunk for w in some))
        enc, ids = encoder(spec), {}
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            ids.update(zip(some, enc.encode_once([w.decode() for w in some]), strict=True))
        out = []
        for some in of_chunk:
            got = [ids[w] for w in some]
            flat = np.frombuffer(b"".join(got), "<u4")
            out.append(chunks.blob((np.array([len(x) // 4 for x in got], np.int64), 3), (flat, 4)))
        del words, ids, of_chunk, got, flat
        give_back()
        return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "payload": out})

    return run


def encode(docs: DataFrame, spec: str, finish: Callable[[list, list[list[bytes]], list[bytes]], pd.DataFrame], schema: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Encode whole texts of a stored table; ``finish(doc_ids, ids_of_words, pieces)`` makes the output rows of some documents.

    ``ids_of_words`` has, for each document, the ids of its words in order, each
    as little-endian unsigned 32-bit integers. Rows of ``schema``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", "text")
    asked = texts.mapInArrow(_chunk_pass(spec, n, chunk_chars, True), chunks.CODED).select("chunk", "part", "payload")
    coded = texts.mapInArrow(_chunk_pass(spec, n, chunk_chars, False), chunks.CODED).select("chunk", "part", "doc_ids", "payload")
    answers = asked.groupBy("part").applyInPandas(_answer(spec), "chunk string, part int, payload binary")
    pieces = spark.sparkContext.broadcast([p for _, p in pieces_by_id(spec)])

    def join(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or found.empty:
            raise RuntimeError("documents were read in another order the second time; store them first")
        if sorted(found["part"]) != list(range(n)) or rows["part"].duplicated().any():
            raise RuntimeError("a chunk has a part twice or lacks one")
        of: list[bytes] = []
        for payload in found.sort_values("part")["payload"]:
            (lens, flat), _ = chunks.unblob(payload, 3, 4)
            of += _cut_up(lens * 4, flat.astype("<u4").tobytes())
        ids, codes = chunks.documents_of(rows)
        out = []
        for i in range(0, len(ids), 500):
            out.append(finish(ids[i : i + 500], [list(map(of.__getitem__, c.tolist())) for c in codes[i : i + 500]], pieces.value))
        del of, ids, codes
        give_back()
        return pd.concat(out)

    return coded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(join, schema)


def decoded(ids: bytes, pieces: list[bytes]) -> bytes:
    """Text of ids (little-endian unsigned 32-bit integers), in UTF-8."""
    joined = b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return joined.decode("utf-8", "replace").encode()


def _ids(values: list) -> pd.Series:
    return pd.Series([None if v is None or v != v else int(v) for v in values], dtype="Int64")


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the text decoded from them."""

    def finish(doc_ids: list, of_words: list[list[bytes]], pieces: list[bytes]) -> pd.DataFrame:
        ids = [b"".join(w) for w in of_words]
        return pd.DataFrame(
            {
                "doc_id": _ids(doc_ids),
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(decoded(x, pieces)).hexdigest() for x in ids],
            }
        )

    return encode(docs, spec, finish, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, spec: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id and its ids as ``array<int>``."""

    def finish(doc_ids: list, of_words: list[list[bytes]], pieces: list[bytes]) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": _ids(doc_ids), "ids": [np.frombuffer(b"".join(w), "<i4") for w in of_words]})

    return encode(docs, spec, finish, "doc_id bigint, ids array<int>", chunk_chars)


def decode(rows: DataFrame, spec: str) -> DataFrame:
    """Text for rows of (doc_id, ids): ``text`` as the library's ``decode`` gives it.

    The id-to-piece table has the vocabulary's fixed size and goes to each task;
    rows stay where they are.
    """
    pieces = rows.sparkSession.sparkContext.broadcast([p for _, p in pieces_by_id(spec)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pieces.value
        for b in batches:
            texts = [decoded(np.array(x or [], "<u4").tobytes(), of).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
