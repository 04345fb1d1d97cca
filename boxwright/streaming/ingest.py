"""Incremental ingest: detection files as a stream, appended batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from boxwright.operators.mutations import next_rows, skip_existing
from boxwright.store import Store


def incremental(spark: SparkSession, source: str, schema: str, store: Store, checkpoint: str, order: list[str], table: str = "predictions", files_per_batch: int = 1, known_images: bool = False) -> None:
    """Take up what is new under ``source`` and stop.

    Each batch numbers its rows on from the highest id and is appended as files of
    its own; what the table has is not written again. The checkpoint takes each
    file once. The table's log has the last batch of each stream, by the id that
    its checkpoint gave it, so a batch that is run again after a failure is known,
    whatever was written since, and several streams may feed one table at once.
    Rows of one image may lie in several files. ``known_images`` drops rows of images
    that the table had when the run began, for files delivered a second time.
    """
    before = store.read(table).select("image_path").distinct() if known_images else None
    writer: list[str] = []

    def take(batch: DataFrame, number: int) -> None:
        if not writer:
            writer.append(json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()["value"])["id"])
        if store.has_batch(table, number, writer[0]):
            return
        rows = batch if before is None else skip_existing(batch, before)
        store.append(table, lambda now: next_rows(now, rows, order), number, writer[0])

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
