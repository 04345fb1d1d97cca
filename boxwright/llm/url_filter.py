"""Listed hosts and paths, found without a join (Bloom filter cascade).

A list names beginnings of addresses: a host, which stands for its subdomains
too, and what a path must begin with. The addresses of a corpus have a bounded
number of such beginnings (one for each shape - labels of a host, characters of a
path - that the list has). All of these are the universe of keys. The first
filter holds the listed keys of the universe; the second those of the others that
the first takes for listed; the third the listed that the second takes for
others; and so on until a filter errs no more. Then membership is exact for every
key of the corpus, and an address is judged by looking bits up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.session import cut, scratch

#: Bits a key in the first filter (more where the others far outnumber the listed) and in later ones.
FIRST_BITS, LATER_BITS = 8, 8
#: Bits that all filters of a shard have at most, by the count of its keys; a longer list has more shards, each asked in a pass of its own.
SHARD_BITS = 1 << 28
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ROUNDS = 60


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://``: the host in lower case, and the path; '' where there is none."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, ADDRESS, 1), UPPER, LOWER), F.regexp_extract(text, ADDRESS, 2)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def shapes(listed: DataFrame) -> list[tuple[int, int]]:
    """(labels, path characters) of the listed keys: as many as there are different ones, whatever the keys' number."""
    found = listed.filter("host is not null and path is not null").select(_labels(F.col("host")).alias("n"), F.length("path").alias("p")).distinct().collect()
    return sorted((r["n"], r["p"]) for r in found)


def candidates(host: Column, path: Column, of: list[tuple[int, int]]) -> Column:
    """The beginnings of an address that have one of the shapes."""
    if not of:
        return F.array().cast("array<string>")
    have, long = _labels(host), F.length(path)
    fits = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in of)), lambda s: (s["n"] <= have) & (s["p"] <= long))
    return F.transform(fits, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["n"]), F.substring(path, F.lit(1), s["p"])))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(F.lit(1), key)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bits of keys in a level's filter, a row a key. Levels are independent of each other."""
    with np.errstate(over="ignore"):
        salt = _mixed(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        a, b = _mixed(h1 + salt), _mixed(h2 ^ salt) | np.uint64(1)
        return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


@dataclass
class Level:
    """One Bloom filter."""

    number: int
    bits: int
    hashes: int
    words: np.ndarray

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        if not len(h1):
            return np.zeros(0, bool)
        at = _places(h1, h2, self.number, self.bits, self.hashes)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _level(keys: DataFrame, n: int, number: int, bits_a_key: int) -> Level:
    """The filter of keys (h1, h2): words are put together by tasks, then by Spark, and only they reach the driver."""
    bits, hashes = max(64, n * bits_a_key), max(1, round(bits_a_key * 0.69))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(_u64(batch.column("h1")), _u64(batch.column("h2")), number, bits, hashes).ravel()
            word, order = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, order, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"])

    found = keys.select("h1", "h2").mapInArrow(run, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    words = np.zeros(-(-bits // 64), np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["value"].to_numpy(np.int64).view(np.uint64)
    return Level(number, bits, hashes, words)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.arrow_udf("boolean")
    def test(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(shared.value.has(_u64(h1), _u64(h2)))

    return keys.filter(test("h1", "h2"))


def _member(spark: SparkSession, levels: list[Level], shard: int, shards: int):
    """Which hashes of each row's keys are in a shard of the list: the last filter that takes a key decides."""
    shared = spark.sparkContext.broadcast(levels)

    @F.arrow_udf("array<boolean>")
    def test(h1: pa.Array, h2: pa.Array) -> pa.Array:
        a, b = _u64(h1.flatten()), _u64(h2.flatten())
        inside = np.zeros(len(a), bool)
        at = np.flatnonzero(b % np.uint64(shards) == shard)
        for k, level in enumerate(shared.value):
            at = at[level.has(a[at], b[at])]
            inside[at] = k % 2 == 0
        ends = np.concatenate([[0], np.cumsum(h1.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(inside))

    return test


class Cascade:
    """Exact membership of a corpus's keys in a list. ``shards``: the levels of each shard of the list."""

    def __init__(self, spark: SparkSession, shards: list[list[Level]]):
        self.spark, self.shards = spark, shards

    def among(self, rows: DataFrame, keys: str, name: str) -> DataFrame:
        """``rows`` with a column ``name``: the keys of an array column that the list has. A pass for each shard."""
        n = len(self.shards)
        for i, levels in enumerate(self.shards):
            test = _member(self.spark, levels, i, n)
            h1, h2 = F.transform(keys, lambda k: _hashes(k)[0]), F.transform(keys, lambda k: _hashes(k)[1])
            hit = F.transform(F.filter(F.arrays_zip(F.col(keys).alias("k"), test(h1, h2).alias("hit")), lambda x: x["hit"]), lambda x: x["k"])
            rows = rows.withColumn(name, hit if i == 0 else F.concat(name, hit))
            if i < n - 1:
                rows = cut(rows, "passes")
        return rows


def cascade(universe: DataFrame, listed: DataFrame, first_bits: int = FIRST_BITS, later_bits: int = LATER_BITS, shard_bits: int = SHARD_BITS) -> Cascade:
    """A cascade for the distinct keys of a corpus (``key``) and those of a list.

    The list meets the universe once, here; who asks the filters joins nothing.
    """
    spark = universe.sparkSession
    with scratch(spark) as own:
        both = universe.select("key").join(listed.select("key").distinct().withColumn("in", F.lit(True)), "key", "left")
        both = own(both.select(*(h.alias(n) for h, n in zip(_hashes(F.col("key")), ("h1", "h2"), strict=True)), F.coalesce("in", F.lit(False)).alias("in")), "universe")
        n_in, n_out = both.agg(F.count_if("in"), F.count_if(~F.col("in"))).first()
        bits = first_bits + max(0, int(np.ceil(1.44 * np.log2(max(1, n_out) / max(1, n_in)))))
        shards = max(1, -(-n_in * bits * 2 // shard_bits))
        out = []
        for i in range(shards):
            # the remainder of an unsigned number, of a signed one
            part = F.pmod(F.pmod(F.shiftrightunsigned("h2", 1), F.lit(shards)) * 2 + F.col("h2").bitwiseAND(F.lit(1)), F.lit(shards))
            mine = both.filter(part == i) if shards > 1 else both
            members, others, levels = mine.filter("in"), mine.filter(~F.col("in")), []
            n = members.count()
            while n:
                if len(levels) == ROUNDS:
                    raise RuntimeError("two keys have the same hashes")
                levels.append(_level(members, n, len(levels), later_bits if levels else bits))
                members, others = own(_passing(others, levels[-1]), "passing"), members
                n = members.count()
            out.append(levels)
    return Cascade(spark, out)


def _longest(keys: Column) -> Column:
    """The longest key; of equal ones that of the longer host."""
    ranked = F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("h"), k.alias("k")))
    return F.array_max(ranked)


def judged(rows: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow", **how) -> DataFrame:
    """``rows`` with host, path, rule and verdict; columns of these names are replaced.

    ``rules`` (host, path, verdict allow or block): the longest that fits counts, a block before an allow of
    the same key. Where none fits, addresses under a key of ``listed`` (host, path) are blocked, and all
    others have ``default``. Null addresses have no host; rows that repeat are judged alike.
    """
    host, path = host_and_path(F.col(url))
    kept = [c for c in rows.columns if c not in ("host", "path", "rule", "verdict")]
    key = lambda df: df.filter("host is not null and path is not null").select(F.concat("host", "path").alias("key"))
    lists = {"allow": rules.filter("verdict = 'allow'"), "block": rules.filter("verdict = 'block'"), "other": listed}
    parts = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), host.alias("host"), path.alias("path"))
    narrow = rows.select(host.alias("host"), path.alias("path")).distinct()
    for name, of in lists.items():
        fit = shapes(of)
        universe = narrow.select(F.explode(candidates(F.col("host"), F.col("path"), fit)).alias("key")).distinct()
        parts = parts.withColumn(f"keys_{name}", candidates(F.col("host"), F.col("path"), fit))
        parts = cascade(universe, key(of), **how).among(parts, f"keys_{name}", f"in_{name}")
    allow, block = _longest(F.col("in_allow")), _longest(F.col("in_block"))
    blocked = block.isNotNull() & (allow.isNull() | (block >= allow))
    verdict = F.when(blocked, "block").when(allow.isNotNull(), "allow").when(F.size("in_other") > 0, "block").otherwise(default)
    return parts.select("row.*", "host", "path", F.when(blocked, block["k"]).otherwise(allow["k"]).alias("rule"), verdict.alias("verdict"))
