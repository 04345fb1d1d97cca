"""From raw documents to token ids: five stages, each over all that its predecessor kept.

Every stage is written as Parquet and read again before the next, so a lost
executor costs no more than one stage. All but the last return the columns of
``documents``. Documents without words go with the first stage; nulls in other columns
stay as they are, equal rows are one document of a group, and an empty table stays empty.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm import bpe, decontaminate, pii, quality, queries, simhash
from boxwright.session import drop_path, saved, scratch_path


#: Executors also hold what the stages before have left, so chunks are smaller than the operator's own; words then travel more often.
CHUNK_CHARS = 5_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, and documents that are mostly made of them."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid numbers, addresses and dates become pseudonyms."""
    return pii.pseudonymise(docs, queries.PII_KEY)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of the whole text."""
    rows = bpe.token_ids(docs, queries.spec(), CHUNK_CHARS)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once a stage is written, its scratch tables and the table before it go."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.lower().replace(" ", "-"))
        docs = saved(spark, partial(stage, spark, docs, sf_dir), path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, pseudonyms and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
