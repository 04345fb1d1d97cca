"""Conversations as a trie of the beginnings that they share.

Burst tries: suffixes wait in containers under the heads of the trie. A container
that holds too many bursts: what all its suffixes begin with becomes a chain of
nodes, and the next turn sends each suffix to a container of its own. Containers
that are small enough are dealt out to shards, sorted, and swept into nodes; the
heads that burst are summed up from their containers, the deepest first.

A conversation travels as its path: 20 bytes a turn, 16 of a digest of role and
text and 4 of the text's length. Equal conversations are one path with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.memory import give_back, small_batches
from boxwright.session import cut, scratch

#: Bytes of a turn in a path; suffixes that a container holds; ids that one row of a hot path holds.
UNIT, HOLDS, PIECE = 20, 4096, 10_000
#: Turns of the base conversation that others may begin with.
MOST_SHARED = 8
#: Nodes that a task sweeps together.
SWEPT = 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = "head binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _digest(x: Column) -> Column:
    return F.unhex(F.substring(F.sha2(x, 256), 1, 32))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path of every conversation as rebuilt: the first turns of its base, then its own after as many.

    Turns stand by number, null first, those of one number by their digest. Null roles and texts are empty;
    rows without a conversation's id belong to none.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    same = F.substring(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256), 1, 32)
    unit = F.concat(same, F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    base = F.col("conv_id") - F.col("conv_id") % 5
    rows = conversations.filter("conv_id is not null").select("conv_id", base.alias("base"), F.struct("turn", unit.alias("unit")).alias("t"))
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t"))["unit"].alias("t"))
    family = own.groupBy("base").agg(F.collect_list(F.struct("conv_id", "t")).alias("of"))
    first = F.slice(F.get(F.filter("of", lambda c: c["conv_id"] == F.col("base")), F.lit(0))["t"], 1, MOST_SHARED)
    each = family.select(F.coalesce(first, F.array().cast("array<string>")).alias("first"), F.explode("of").alias("c"))
    h = F.crc32(F.col("c.conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    turns = F.concat(F.slice("first", F.lit(1), h.cast("int")), F.slice("c.t", (h + 1).cast("int"), F.size("c.t")))
    return each.select("c.conv_id", F.unhex(F.array_join(turns, "")).alias("path"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one path after another, by piece: one row a path, its ids hashed as they pass."""
    now, h, row = None, None, []

    def made(rows: list) -> pa.RecordBatch:
        names = ["path", "n", "least", "ends"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

    for batch in batches:
        done = []
        for whole, path, n, least, ids in zip(*(batch.column(c).to_pylist() for c in ("whole", "path", "n", "least", "ids")), strict=True):
            if whole != now:
                if now is not None:
                    done.append((*row, h.hexdigest()))
                now, h, row = whole, hashlib.sha256(ids.encode()), [path, n, least]
            else:
                h.update(b"," + ids.encode())
                row[1] += n
        if done:
            yield made(done)
    if now is not None:
        yield made([(*row, h.hexdigest())])


def sequences(rebuilt: DataFrame) -> DataFrame:
    """path, n, least, ends of each different path: its conversations, the least, and the hash of all their ids.

    A path may be a third of all conversations. Their ids go into rows of a bounded range each; the
    task that hashes them, as one hash must, sees one such row at a time.
    """
    ids = F.sort_array(F.collect_list("conv_id"))
    parts = rebuilt.groupBy(_digest(F.col("path")).alias("whole"), F.expr(f"conv_id div {PIECE}").alias("piece")).agg(F.first("path").alias("path"), ids.alias("ids"))
    parts = parts.select("whole", "piece", "path", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("least"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return parts.repartition("whole").sortWithinPartitions("whole", "piece").mapInArrow(_hashed, "path binary, n bigint, least bigint, ends string")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with."""
    k, most = 0, min(len(a), len(b))
    while k < most and a[k : k + UNIT] == b[k : k + UNIT]:
        k += UNIT
    return k // UNIT


def _bytes_of(path: bytes) -> np.ndarray:
    return np.frombuffer(path, np.dtype([("same", "V16"), ("n", ">u4")]))["n"].astype(np.int64)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What all suffixes of a container begin with is what its first and its last do."""
    for batch in batches:
        low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
        chain = pa.array([a[: UNIT * _common(a, b)] for a, b in zip(low, high, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("head", "parent", "depth", "last")), chain], names=["head", "parent", "depth", "last", "chain"])


HEADS = "head binary, parent binary, depth bigint, last bigint, chain binary"


def _burst(rows: DataFrame, full: DataFrame) -> DataFrame:
    """Suffixes with their next container; ``state`` 0 stays where it is, 1 ends where the burst is, 2 goes on."""
    joined = rows.join(full.select("head", "chain"), "head", "left")
    after = F.col("suffix").substr(F.length("chain") + 1, F.length("suffix"))
    joined = joined.withColumn("state", F.when(F.col("chain").isNull(), 0).when(F.length("chain") == F.length("suffix"), 1).otherwise(2)).withColumn("after", after)
    goes = F.col("state") == 2
    unit = F.col("after").substr(1, UNIT)
    new = {
        "parent": F.when(goes, F.col("head")).otherwise(F.col("parent")),
        "head": F.when(goes, _digest(F.concat("head", "chain", unit))).otherwise(F.col("head")),
        "depth": F.when(goes, F.col("depth") + F.expr(f"length(chain) div {UNIT}") + 1).otherwise(F.col("depth")),
        "last": F.when(goes, F.conv(F.hex(F.col("after").substr(17, 4)), 16, 10).cast("long")).otherwise(F.col("last")),
        "suffix": F.when(goes, F.col("after").substr(F.lit(UNIT + 1), F.length("after"))).otherwise(F.col("suffix")),
    }
    return joined.select("state", *(new[c].alias(c) if c in new else c for c in rows.columns))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers, from rows sorted by container and suffix; some containers at a time."""
    tops: list = []
    above: list[int] = []
    level: list[int] = []
    size: list[np.ndarray] = []
    found: list[tuple[int, int, int, str]] = []
    stack: list[int] = []
    now, before = None, b""
    try:
        for batch in batches:
            for head, parent, depth, last, suffix, n, least, ends in zip(*(batch.column(c).to_pylist() for c in ("head", "parent", "depth", "last", "suffix", "n", "least", "ends")), strict=True):
                if head != now:
                    if len(above) >= SWEPT:
                        yield _nodes(tops, above, level, size, found)
                        tops, above, level, size, found = [], [], [], [], []
                    now, before, stack = head, b"", [len(above)]
                    tops.append((len(above), head, parent))
                    above.append(-1)
                    level.append(depth)
                    size.append(np.array([last]))
                k, first = _common(before, suffix), len(above)
                del stack[k + 1 :]
                new = len(suffix) // UNIT - k
                if new:
                    above += [stack[k], *range(first, first + new - 1)]
                    stack += range(first, first + new)
                    level += range(depth + k + 1, depth + k + 1 + new)
                    size.append(_bytes_of(suffix)[k:])
                found.append((stack[-1], n, least, ends))
                before = suffix
        if above:
            yield _nodes(tops, above, level, size, found)
    finally:
        give_back()


def _nodes(tops: list, above: list[int], level: list[int], size: list[np.ndarray], found: list) -> pa.RecordBatch:
    """Rows of NODES, summed up from the deepest nodes to the tops of their containers."""
    m = len(above)
    up, depth, bytes_ = np.array(above), np.array(level), np.concatenate(size)
    n, least, saved = np.zeros(m, np.int64), np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
    ends = np.full(m, NO_ENDS, object)
    for at, count, low, of in found:
        n[at], least[at], ends[at] = count, low, of
    children = np.bincount(up[up >= 0], minlength=m)
    leaves = (children == 0).astype(np.int64)
    order = np.argsort(-depth, kind="stable")
    for of in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        saved[of] += (n[of] - 1) * bytes_[of]
        inner = of[up[of] >= 0]
        for total in (n, leaves, saved):
            np.add.at(total, up[inner], total[inner])
        np.minimum.at(least, up[inner], least[inner])
    head, parent = np.full(m, None, object), np.full(m, None, object)
    for at, h, p in tops:
        head[at], parent[at] = h, p
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
    columns = [head, parent, least, depth, pa.array(least[up], mask=up < 0), n, children, leaves, saved, ends]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[f.split(" ")[0] for f in NODES.split(", ")])


def _head_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chain of nodes of each head that burst; all have the same members."""
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            size = np.concatenate([[r["last"]], _bytes_of(r["chain"])])
            saved = r["saved"] + (r["n"] - 1) * np.cumsum(size[::-1])[::-1]
            for j in range(len(size)):
                end = j == len(size) - 1
                out.append((r["head"] if j == 0 else None, r["parent"] if j == 0 else None, r["least"], r["depth"] + j, None if j == 0 else r["least"], r["n"], r["children"] if end else 1, r["leaves"], int(saved[j]), (r["ends"] or NO_ENDS) if end else NO_ENDS))
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
        cols = zip(*out) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=[f.split(" ")[0] for f in NODES.split(", ")])


def trie(conversations: DataFrame, holds: int = HOLDS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations``: conv_id, turn, role, text; other columns are not read. Repeated rows are turns
    of their own. An empty table has no nodes. Rounds follow the branchings of overfull containers, not
    the turns: a beginning that all of a container share is passed in one.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    with scratch(spark) as own:
        start = sequences(paths(conversations)).select(F.unhex(F.lit("00")).alias("head"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("last"), F.col("path").alias("suffix"), "n", "least", "ends")
        rows = own(start, "sequences")
        waiting, heads, ended = [], [], []
        while True:
            sized = rows.groupBy("head").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("last").alias("last"), F.min("suffix").alias("low"), F.max("suffix").alias("high"), F.count("*").alias("size"))
            full = own(sized.filter(F.col("size") > max(holds, 1)).drop("size").mapInArrow(_chains, HEADS), "full")
            if full.isEmpty():
                waiting.append(rows)
                break
            moved = own(_burst(rows, full), "burst")
            waiting.append(moved.filter("state = 0").drop("state"))
            ended.append(moved.filter("state = 1").drop("state"))
            heads.append(full)
            rows = moved.filter("state = 2").drop("state")
        held = waiting[0]
        for w in waiting[1:]:
            held = held.union(w)
        nodes = cut(held.repartition("head").sortWithinPartitions("head", "suffix").mapInArrow(_sweep, NODES), "nodes")
        tops = nodes.filter("head is not null").select("parent", F.col("conv_id").alias("least"), F.col("n_convs").alias("n"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        known = None
        for full, at_head in zip(reversed(heads), reversed(ended), strict=True):
            below = tops.select(F.col("parent").alias("head"), "least", "n", "leaves", "saved", F.lit(1).cast("long").alias("children"), F.lit(None).cast("string").alias("ends"))
            ends_here = at_head.select("head", "least", "n", *(F.lit(0).cast("long").alias(c) for c in ("leaves", "saved", "children")), "ends")
            sums = below.union(ends_here).groupBy("head").agg(F.min("least").alias("least"), *(F.sum(c).alias(c) for c in ("n", "leaves", "saved", "children")), F.max("ends").alias("ends"))
            done = cut(full.join(sums, "head").mapInArrow(_head_nodes, NODES), "heads")
            known = done if known is None else known.union(done)
            tops = tops.union(done.filter("head is not null").select("parent", F.col("conv_id").alias("least"), F.col("n_convs").alias("n"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    out = [F.col(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    if known is None:
        return nodes.select(*out)
    both = nodes.union(known)
    of = known.filter("head is not null").select(F.col("head").alias("parent"), F.col("conv_id").alias("_least"))
    under = both.filter("head is not null").drop("parent_conv_id").join(of, "parent", "left").withColumnRenamed("_least", "parent_conv_id")
    return both.filter("head is null").select(*out).union(under.select(*out))
