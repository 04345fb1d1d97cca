"""Exact k-means on integer vectors, by bounds (Shallot search).

Every vector remembers its nearest and second-nearest centroid, a bound above on
the distance to the first and one below on that to all others. Where the bounds
can't settle a round, the search starts from the closer of the two and looks at
the other centroids in order of their distance from it; the ball that it has to
look at shrinks with the second-best distance found. Bounds are doubles with a
margin; vectors that they leave open are compared in integers.

Vectors lie in blocks with their state, so that a round is one pass over the
blocks without a shuffle; what it sends on is one sum a block and centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.memory import give_back, small_batches
from boxwright.session import cut, drop_path, written

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Components of this size or more have squared distances that a long can't hold.
LIMIT = 1 << 27
#: Vectors of a block; bounds are trusted as far as this share and amount.
BLOCK, SHARE, AMOUNT = 4096, 1e-9, 1e-6

STATE = "ids array<bigint>, x binary, near binary, second binary, upper binary, lower binary, sums array<bigint>"


def integers(vectors: DataFrame, column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: vectors of so many finite components, as integers floor(scale * x)."""
    x = F.transform(column, lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT / scale))
    return vectors.filter((F.size(column) == dims) & good).select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The vectors of the k least hashes of seed and id; ties by their components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in rows.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances in integers; x and c have equal rows, or c is one vector."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _wide(x: np.ndarray) -> np.ndarray:
    """A little more than x, for lengths that were made of rounded roots."""
    return x * (1 + SHARE) + AMOUNT


class Search:
    """One round's centroids: what their distances and moves say about a block."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.c, k = now, len(now)
        apart = np.sqrt(np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in now] for p in now], np.float64)).reshape(k, k)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = apart
        self.half = np.where(np.eye(k, dtype=bool), np.inf, apart).min(1) / 2 if k > 1 else np.full(k, np.inf)
        self.moved = np.sqrt(((now - before).astype(np.float64) ** 2).sum(1)) if before is not None else np.zeros(k)
        self.others = np.array([np.delete(self.moved, j).max() if k > 1 else 0.0 for j in range(k)])

    def run(self, x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Bring a block's state up to date, in place."""
        if len(self.c) == 1:
            return
        upper[:] = _wide(upper + self.moved[near])
        lower[:] = (lower - self.others[near]) * (1 - SHARE) - AMOUNT
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.half[near] * (1 - SHARE) - AMOUNT))
        d = _distances(x[open_], self.c[near[open_]])
        upper[open_] = _wide(np.sqrt(d))
        still = upper[open_] >= np.maximum(lower[open_], self.half[near[open_]] * (1 - SHARE) - AMOUNT)
        at, d = open_[still], d[still]
        other = _distances(x[at], self.c[second[at]])
        a, b = near[at], second[at]
        swap = (other < d) | ((other == d) & (b < a))
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        d, other = np.where(swap, other, d), np.where(swap, d, other)
        start, reach = a.copy(), _wide(np.sqrt(d))
        known = b.copy()
        for j in np.unique(start):
            of = np.flatnonzero(start == j)
            for c in self.order[j]:
                of = of[self.apart[j, c] <= reach[of] + _wide(np.sqrt(other[of]))]
                if not len(of):
                    break
                look = of[(known[of] != c)] if c != j else of[:0]
                new = _distances(x[at[look]], self.c[c])
                first = (new < d[look]) | ((new == d[look]) & (c < a[look]))
                after = ~first & ((new < other[look]) | ((new == other[look]) & (c < b[look])))
                f, s = look[first], look[after]
                b[f], other[f], a[f], d[f] = a[f], d[f], c, new[first]
                b[s], other[s] = c, new[after]
        near[at], second[at] = a, b
        upper[at], lower[at] = _wide(np.sqrt(d)), np.sqrt(other) * (1 - SHARE) - AMOUNT


def _sums(x: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Per centroid its vectors and the sums of their components, one after the other."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    for j in range(k):
        mine = near == j
        out[j, 0], out[j, 1:] = mine.sum(), x[mine].sum(0)
    return out.ravel()


def _packed(ids: list, x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, k: int) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5, pa.list_(pa.int64())]
    cells = [ids, x.astype("<i4").tobytes(), near.astype("<i2").tobytes(), second.astype("<i2").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes(), _sums(x, near, k)]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=[f.split(" ")[0] for f in STATE.split(", ")])


def _first_pass(centroids: np.ndarray):
    """From rows of vectors to blocks with their state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Search(centroids, None), len(centroids)

        def block(ids: list, x: np.ndarray) -> pa.RecordBatch:
            n = len(ids)
            near, second = np.zeros(n, np.int64), np.full(n, min(1, k - 1), np.int64)
            upper, lower = np.full(n, np.inf), np.zeros(n)
            search.run(x, near, second, upper, lower)
            return _packed(ids, x, near, second, upper, lower, k)

        ids: list = []
        parts: list[np.ndarray] = []
        try:
            for batch in batches:
                ids += batch.column("vec_id").to_pylist()
                parts.append(batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, centroids.shape[1]))
                if len(ids) >= BLOCK:
                    x = np.concatenate(parts)
                    cut_at = len(ids) - len(ids) % BLOCK
                    for i in range(0, cut_at, BLOCK):
                        yield block(ids[i : i + BLOCK], x[i : i + BLOCK])
                    ids, parts = ids[cut_at:], [x[cut_at:]]
            if ids:
                yield block(ids, np.concatenate(parts))
        finally:
            give_back()

    return run


def _pass(now: np.ndarray, before: np.ndarray, last: bool):
    """A round over blocks; the last gives the vectors' ids, clusters and distances instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Search(now, before), len(now)
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = batch.column("ids")[i].as_py()
                    raw = [batch.column(c)[i].as_py() for c in ("x", "near", "second", "upper", "lower")]
                    x = np.frombuffer(raw[0], "<i4").astype(np.int64).reshape(len(ids), -1)
                    near, second = (np.frombuffer(r, "<i2").astype(np.int64) for r in raw[1:3])
                    upper, lower = (np.frombuffer(r, "<f8").copy() for r in raw[3:])
                    search.run(x, near, second, upper, lower)
                    if last:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.int32()), pa.array(_distances(x, now[near]), pa.int64())], names=["vec_id", "cluster", "distance"])
                    else:
                        yield _packed(ids, x, near, second, upper, lower, k)
        finally:
            give_back()

    return run


def _next(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each centroid's vectors; one without any stays."""
    k, dims = centroids.shape
    sums = state.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    total = np.zeros(k * (dims + 1), object)
    for r in sums:
        total[r["at"]] = int(r["s"])
    total = total.reshape(k, dims + 1)
    return np.array([[s // row[0] for s in row[1:]] if row[0] else c.tolist() for row, c in zip(total, centroids, strict=True)], np.int64).reshape(k, dims)


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, column: str = "embedding", dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that is kept, and the final centroids.

    Vectors with a null, a component that isn't finite or that a long can't measure (131,072 or more
    in size), or another length are left out. Null ids are kept. Only centroids, and one sum each and
    component, reach the driver; each round's blocks go when the next round's are written.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = integers(vectors, column, dims, scale)
    now = first_centroids(rows, k, seed)
    if not len(now):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), now.reshape(0, dims)
    made = rows.mapInArrow(_first_pass(now), STATE)
    state, path = written(made, "blocks")
    before = now
    for r in range(rounds):
        before, now, old = now, _next(state, now), path
        if r < rounds - 1:
            state, path = written(state.mapInArrow(_pass(now, before, False), STATE), "blocks")
            drop_path(spark, old)
    found = cut(state.mapInArrow(_pass(now, before, True), "vec_id bigint, cluster int, distance bigint"), "clusters")
    drop_path(spark, path)
    return found, now


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept."""
    found, centroids = clusters(vectors)
    spark = vectors.sparkSession
    per = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    about = [(j, d, sum(per.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, d in per.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
