"""SimHash near-duplicates by covering anchors.

Fingerprints have 64 bits; two are linked when at most THRESHOLD (2) differ.
Anchors are the words of the perfect Hamming code of length 63, with the last
bit free: its covering radius is 1. If x and y differ in two bits or fewer, a
point between them is one step at most from each, and the anchor that covers
that point is at most radius 1 + half the threshold 1 = 2 steps away from
both. So each distinct fingerprint goes to every anchor in that distance (33
of them: by its syndrome, they are all found by table), and fingerprints are
compared only with those at the same anchor. An anchor can't have more than
the 2,018 points around it for either value of the free bit, however large a
group of copies is, since equal fingerprints are one point.

Links leave an anchor as stars (each fingerprint with the least that it
reaches there), never as all pairs. Components then follow from all stars.

Null and empty texts have fingerprint zero and are linked like any other.
Rows with a null id take part; a component of none but such rows has a null
component_id. Repeated rows are equal points. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.components import connected_components, local_stars
from boxwright.llm.memory import give_back, small_batches
from boxwright.llm.native import renamed
from boxwright.llm.verdicts import few
from boxwright.session import cut

SHINGLE = 3
SEED = 42
THRESHOLD = 2


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < size:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, any more long columns asked for, and fp: the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in more), pa.array(fp)], names=["doc_id", *more, "fp"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", *more, "text").mapInArrow(run, "".join(f"`{c}` bigint, " for c in ("doc_id", *more)) + "fp bigint")


def _anchor_masks() -> np.ndarray:
    """[64, 33] masks that lead from a point with a syndrome to its anchors.

    Bits 0 to 62 are the places 1 to 63 of the code; a syndrome is the XOR of
    the places that are set. Flipping place s leads to a code word, and so does
    each pair of places whose XOR is s. With the free bit flipped one step is
    left. Unused entries repeat the first.
    """
    bit = lambda place: 1 << (place - 1)
    table = []
    for s in range(64):
        near = [bit(s) if s else 0]
        pairs = [bit(i) | bit(i ^ s) for i in range(1, 64) if s and i < i ^ s]
        row = [*near, *pairs, near[0] | 1 << 63]
        table.append(row + [row[0]] * (33 - len(row)))
    return np.array(table, np.uint64)


ANCHOR_MASKS = _anchor_masks()
_PARITY = [np.uint64(sum(1 << (p - 1) for p in range(1, 64) if p >> k & 1)) for k in range(6)]


def anchors(fp: np.ndarray) -> np.ndarray:
    """[n, 33] anchors of fingerprints (unsigned)."""
    s = np.zeros(len(fp), np.int64)
    for k, mask in enumerate(_PARITY):
        s |= (np.bitwise_count(fp & mask).astype(np.int64) & 1) << k
    return fp[:, None] ^ ANCHOR_MASKS[s]


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 4000):
            fp = np.ascontiguousarray(whole.column("fp").to_numpy()[i : i + 4000]).view(np.uint64)
            at = np.sort(anchors(fp), axis=1)
            fresh = np.concatenate([np.ones((len(at), 1), bool), at[:, 1:] != at[:, :-1]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at[fresh].view(np.int64)), pa.array(np.repeat(fp, fresh.sum(1)).view(np.int64))], names=["anchor", "fp"])


def _compare(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links among fingerprints with equal anchors, which stand together."""
    begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.concatenate([begins, [len(anchor)]]))
    a, b = [], []
    two = begins[sizes == 2]
    near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= THRESHOLD
    a.append(fp[two][near]), b.append(fp[two + 1][near])
    for at, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        points = fp[at : at + n]
        low = np.arange(n)
        for i in range(n):  # row by row: n numbers at a time, 2,018 at most
            near = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= THRESHOLD)
            roots = np.unique(low[near])
            if len(roots) > 1:
                low[np.isin(low, roots)] = roots[0]
        away = np.flatnonzero(low != np.arange(n))
        a.append(points[low[away]]), b.append(points[away])
    return np.concatenate(a), np.concatenate(b)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor -> links; an anchor that a batch cuts waits for its rest."""
    anchor, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = _compare(anchor, fp) if len(anchor) else (fp, fp)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        anchor = np.concatenate([anchor, batch.column("anchor").to_numpy()])
        fp = np.concatenate([fp, np.ascontiguousarray(batch.column("fp").to_numpy()).view(np.uint64)])
        if not len(anchor):
            continue
        end = int(np.searchsorted(anchor, anchor[-1], "left"))
        yield out(anchor[:end], fp[:end])
        anchor, fp = anchor[end:], fp[end:]
    yield out(anchor, fp)


def links(points: DataFrame) -> DataFrame:
    """(a, b): links that connect what is within the threshold; ``points`` has distinct fp."""
    placed = points.select("fp").mapInArrow(_to_anchors, "anchor bigint, fp bigint")
    return placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: local_stars(_links(batches)), "a bigint, b bigint")


def _named(prints: DataFrame) -> DataFrame:
    """fp, component (its least fingerprint), component_id (its least doc_id), one row a distinct fp."""
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    of = connected_components(links(points), "simhash", stars=True)
    placed = points.join(of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    placed = cut(placed, "components")
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return placed.select("fp", "component").join(least, "component")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component, component_id, one row a document."""
    prints = cut(fingerprints(docs), "fingerprints")
    return prints.join(_named(prints), "fp").select("doc_id", "fp", "component", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return components(docs).select("doc_id", text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays: of its least id (null last), and of those the one whose text has the least hash.

    Of rows that agree in id and text, one stays, whichever Spark meets first. All
    columns stay. Documents meet narrow verdicts, by the hash of id and text, on
    those that go or stand several times; only the latter are put side by side, in
    two steps, so that very many equal rows are no single task. An empty table stays empty.
    """
    names, docs = docs.columns, renamed(docs, "doc_id", "text")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__key"), "text")
    prints = cut(fingerprints(keyed, "__key"), "fingerprints")
    named = _named(prints).select("fp", "component")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "__key")
    chosen = prints.join(named, "fp").groupBy("component").agg(F.min(rank).alias("x")).select(F.xxhash64("x.doc_id", "x.__key").alias("__of"), F.lit(True).alias("__stays")).distinct()
    rows_of = prints.groupBy(F.xxhash64("doc_id", "__key").alias("__of")).agg(F.count("*").alias("__n"))
    verdicts = rows_of.join(chosen, "__of", "left").select("__of", "__n", F.coalesce("__stays", F.lit(False)).alias("__stays")).filter("not __stays or __n > 1")
    verdicts = cut(verdicts, "verdicts")
    met = docs.withColumn("__row", F.xxhash64(F.col("doc_id"), F.xxhash64("text"))).join(few(verdicts), F.col("__row") == F.col("__of"), "left").filter(F.coalesce("__stays", F.lit(True)))
    columns = docs.columns
    if verdicts.filter("__stays and __n > 1").limit(1).count() == 0:
        return met.select(*columns).toDF(*names)
    several = met.filter("__n > 1").withColumn("__salt", F.monotonically_increasing_id() % 64)
    for by in (("__row", "__salt"), ("__row",)):
        first = F.row_number().over(Window.partitionBy(*by).orderBy("__row"))
        several = several.withColumn("__nth", first).filter("__nth = 1").drop("__nth")
    return met.filter("__n is null or __n = 1").select(*columns).unionAll(several.select(*columns)).toDF(*names)
