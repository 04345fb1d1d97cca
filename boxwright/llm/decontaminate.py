"""Benchmark decontamination: token windows against a hash set of test n-grams.

The benchmark's windows (n consecutive words; a shorter item is one window) go
to every task as sorted hashes with the words to verify them by, in sets of
bounded size. Documents are scanned as streams of word numbers: a word outside
the benchmark's vocabulary ends every run, so only runs inside it are hashed.
Hits are verified word by word, then spans of the text are marked.

A benchmark within the bound takes one pass without a shuffle. A larger one is
cut into sets by row, and documents pass once by each, written in between.

Null and empty texts have no words and no hits. Items without words match
nothing. Rows with a null item_id match like others: together they are one item
without a name, which counts and marks spans but isn't in the joined list of
items. Repeated rows, null ids and extra columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxwright.llm.memory import give_back, small_batches
from boxwright.llm.native import renamed
from boxwright.session import cut

WINDOW = 10
#: Words of the benchmark in one set; some 100 bytes each where it is used.
SET_WORDS = 1_000_000

# A-Z becomes a-z; bytes that are no part of a word become spaces. Bytes over
# 0x7F belong to characters that are.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Grams:
    """Windows of some benchmark items, found in runs of word numbers."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.items: list[str | None] = []
        of: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            k, n = len(self.items), min(window, len(ids))
            self.items.append(item)
            for i in range(len(ids) - n + 1):
                of.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(k)
        self.sizes = {}
        for n, grams in of.items():
            rows = np.array(list(grams), np.uint64).reshape(-1, n)
            order = np.argsort(h := self._hash(rows.ravel(), n)[::n] if n > 1 else rows.ravel() * _MIX, kind="stable")
            self.sizes[n] = (h[order], list(np.array(list(grams.values()), object)[order]), rows[order])

    @staticmethod
    def _hash(ids: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n numbers from each place on; the last n - 1 places have none."""
        out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for k in range(n):
            out = out * np.uint64(0x100000001B3) + ids[k : k + len(out)] * _MIX
            out ^= out >> np.uint64(29)
        return out

    def find(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str | None]]]:
        """For each document: hit spans of words (begin, end), merged, and the items that occur."""
        get = self.number.get
        lens = np.array([len(d) for d in docs], np.int64)
        ids = np.zeros(int(lens.sum()) + len(docs), np.uint64)
        begins = np.cumsum(lens + 1) - lens - 1
        for d, at in zip(docs, begins.tolist(), strict=True):
            ids[at : at + len(d)] = np.fromiter((get(w, 0) for w in d), np.uint64, len(d))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        found: dict[int, tuple[list[tuple[int, int]], set[str | None]]] = {}
        for n, (hashes, owners, rows) in self.sizes.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + ids[at + k] * _MIX
                h ^= h >> np.uint64(29)
            if n == 1:
                h = ids[at] * _MIX
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for i in np.flatnonzero(hi > lo).tolist():
                p = int(at[i])
                for g in range(lo[i], hi[i]):
                    if (ids[p : p + n] == rows[g]).all():
                        d = int(np.searchsorted(begins, p, "right")) - 1
                        spans, items = found.setdefault(d, ([], set()))
                        spans.append((p - int(begins[d]), p - int(begins[d]) + n))
                        items.update(self.items[k] for k in owners[g])
        return [(merged(found[i][0]), found[i][1]) if i in found else ([], set()) for i in range(len(docs))]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


FOUND = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("begins", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]
)


def _sets(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Rows in sets of about ``most`` words, or one row if it alone has more; read set by set."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text is not null")
    words = F.size(F.split("text", " ")).cast("long")  # at least a rough count; a set's size needn't be exact
    total = rows.agg(F.sum(F.greatest(words, F.octet_length("text") / 4))).first()[0] or 0
    n = int(total // most) + 1
    for k in range(n):
        yield [(r["item"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toLocalIterator()]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = SET_WORDS, cut_text: bool = False) -> DataFrame:
    """``docs`` with ``__found``: words, merged hit spans (in words) and items of each text.

    ``cut_text`` takes the spans out of the texts, in the same pass that finds the last of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names, at_text = docs.columns, docs.columns.index("text")
    out = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("found", F.lit(None).cast(FOUND))
    at = len(names)
    schema, first = out.schema, True
    sets = _sets(benchmark, most)
    items = next(sets, None)
    while items is not None:
        following = next(sets, None)
        grams = spark.sparkContext.broadcast(Grams(items, window))

        def run(batches: Iterator[pa.RecordBatch], grams=grams, cutting=cut_text and following is None) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, 1000):
                    b = whole.slice(i, 1000)
                    words = [words_of(t) for t in b.column(at_text).to_pylist()]
                    new = []
                    for w, before, (spans, names) in zip(words, b.column(at).to_pylist(), grams.value.find(words), strict=True):
                        if before:
                            spans, names = merged(spans + list(zip(before["begins"], before["ends"], strict=True))), names | set(before["items"])
                        new.append({"n_words": len(w), "begins": [a for a, _ in spans], "ends": [e for _, e in spans], "items": sorted(names, key=lambda x: (x is None, x or ""))})
                    cols = list(b.columns)
                    cols[at] = pa.array(new, b.schema.field(at).type)
                    if cutting and any(x["begins"] for x in new):
                        texts = [without_words(t, list(zip(x["begins"], x["ends"], strict=True))) if x["begins"] else t for t, x in zip(b.column(at_text).to_pylist(), new, strict=True)]
                        cols[at_text] = pa.array(texts, b.schema.field(at_text).type)
                    yield pa.RecordBatch.from_arrays(cols, schema=b.schema)
            give_back()

        if not first:
            out = cut(out, "hits")
        out, first, items = out.mapInArrow(run, schema), False, following
    return out.toDF(*names, "__found")


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    f = find_hits(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate(F.arrays_zip("__found.begins", "__found.ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["begins"])
    return f.select("doc_id", F.col("__found.n_words").alias("n_words"), hit.alias("n_hit"), F.size("__found.items").cast("long").alias("n_items"), F.sha2(F.array_join("__found.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of some spans and what stands between words of one span."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_hit: float = 0.5, window: int = WINDOW) -> DataFrame:
    """Documents without benchmark spans; those hit in over ``most_hit`` of their words go.

    All columns stay; where ``n_chars`` is one, it follows the text.
    """
    columns, docs = docs.columns, renamed(docs, "doc_id", "text", "n_chars")
    f = find_hits(docs, benchmark, window, cut_text=True)
    hit = F.aggregate(F.arrays_zip("__found.begins", "__found.ends"), F.lit(0), lambda n, s: n + s["ends"] - s["begins"])
    kept = f.withColumn("__hit", hit).filter(F.col("__hit") <= F.col("__found.n_words") * most_hit)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__hit") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns).toDF(*columns)
