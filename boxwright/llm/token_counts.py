"""Token counts from an exact histogram of encoded lengths.

Every document is encoded whole and only its length kept. Documents are
aggregated by length; totals from the long end then answer, for every context
limit, how many documents exceed it and how many tokens remain when documents
are cut there. Quantiles come from the same totals.

Null and empty texts have length 0. Repeated rows count each time; ids and extra
columns are not read, and an empty table has an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.llm.memory import give_back, small_batches
from boxwright.llm.prefix import offsets
from boxwright.llm.tokens import encoder, slices
from boxwright.session import cut


def lengths(docs: DataFrame, spec: str) -> DataFrame:
    """One row a document: n_tokens. Nothing but the length leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec)
        for batch in batches:
            for some in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(enc.encode(some.column("text"))[1])], names=["n_tokens"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "n_tokens bigint")


def histogram(docs: DataFrame, spec: str) -> DataFrame:
    """n_tokens, n_docs: exact number of documents of each length."""
    return lengths(docs, spec).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def by_limit(hist: DataFrame) -> DataFrame:
    """For each length L as a context limit: what is longer, and what a cut at L keeps.

    n_tokens (L), n_docs, docs_longer, docs_up_to, tokens_total, tokens_truncated
    (sum over documents of min(length, L)), share_up_to (the quantile at L).
    Limits between two lengths follow from their lower neighbour. Running sums
    go part by part: lengths are dealt out by range and written with their part
    (which two readers then see alike), and each part adds what earlier parts hold.
    """
    dealt = cut(hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).repartitionByRange("n_tokens").withColumn("part", F.spark_partition_id()), "lengths")
    sums = dealt.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before = offsets(sums, "part", "d", "docs_before").join(offsets(sums, "part", "t", "tokens_before"), "part")
    total = dealt.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("tokens_total"))
    upto = Window.partitionBy("part").orderBy("n_tokens")
    rows = dealt.withColumn("d", F.sum("n_docs").over(upto)).withColumn("t", F.sum("tokens").over(upto))
    rows = rows.join(F.broadcast(before), "part").crossJoin(F.broadcast(total))
    rows = rows.withColumn("docs_up_to", F.col("d") + F.col("docs_before")).withColumn("docs_longer", F.col("all_docs") - F.col("docs_up_to"))
    truncated = F.col("t") + F.col("tokens_before") + F.col("docs_longer") * F.col("n_tokens")
    return rows.select("n_tokens", "n_docs", "docs_up_to", "docs_longer", "tokens_total", truncated.alias("tokens_truncated"), (F.col("docs_up_to") / F.col("all_docs")).alias("share_up_to"))


#: Lengths that share a block; a text of 2^31 bytes has at most 524,288 blocks.
BLOCK = 4096


def answer(limits: DataFrame, table: DataFrame) -> DataFrame:
    """Truncated totals for any limits: rows of ``limit`` against a table of ``by_limit``.

    A limit is answered by the largest length not above it, plus what the longer
    documents gain between the two. Lengths and limits meet in blocks of lengths;
    where a limit's own block has none below it, the nearest earlier block with
    lengths serves, and only blocks, whose number the longest text bounds, are put in
    order. Equal limits give one row, null ones none.
    """
    asked = limits.select("limit").filter("limit is not null").distinct().withColumn("block", F.floor(F.col("limit") / BLOCK))
    known = table.select(F.floor(F.col("n_tokens") / BLOCK).alias("block"), F.struct("n_tokens", "docs_longer", "tokens_truncated").alias("x"))
    inside = asked.join(known, "block", "left").groupBy("limit", "block").agg(F.max(F.when(F.col("x.n_tokens") <= F.col("limit"), F.col("x"))).alias("own"))
    last = known.groupBy("block").agg(F.max("x").alias("last"))
    blocks = inside.select("block").distinct()
    ordered = blocks.select("block", F.lit(1).alias("kind"), F.lit(None).cast(last.schema["last"].dataType).alias("last")).union(last.select("block", F.lit(2), "last"))
    before = ordered.withColumn("earlier", F.last("last", ignorenulls=True).over(Window.orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, -1))).filter("kind = 1").select("block", "earlier")
    near = inside.join(before, "block").select("limit", F.coalesce("own", "earlier").alias("x"))
    all_docs = table.agg(F.sum("n_docs").alias("all_docs"))
    gained = F.col("x.tokens_truncated") + F.col("x.docs_longer") * (F.col("limit") - F.col("x.n_tokens"))
    return near.crossJoin(F.broadcast(all_docs)).select("limit", F.coalesce("x.docs_longer", "all_docs").alias("docs_longer"), F.coalesce(gained, F.col("all_docs") * F.col("limit")).alias("tokens_truncated"))


def quantile(table: DataFrame, q: float) -> int | None:
    """Smallest length that at least a share q of the documents does not exceed."""
    row = table.filter(F.col("share_up_to") >= q).agg(F.min("n_tokens").alias("n")).first()
    return row["n"]
