"""Crops and sharpness of boxes, from Spark's decoded images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from boxwright.functions import boxes
from boxwright.llm.memory import give_back, small_batches

#: Bytes of crops, and boxes, that a task holds before it hands them on.
CROP_BYTES, BOXES = 8 << 20, 1000


def images(spark: SparkSession, root: str) -> DataFrame:
    """image_path, width, height, channels, data (rows from the top, blue green red)."""
    found = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root)
    return found.select(F.regexp_replace("image.origin", "^file:/+", "/").alias("image_path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def crops(pictures: DataFrame, rows: DataFrame) -> DataFrame:
    """roi_index, width, height, channels, data of each box cut from its image; boxes outside have no bytes.

    The boxes of an image travel together, and the image once. A task holds a few images at a time, and of
    their crops CROP_BYTES, however many boxes there are.
    """

    kind = rows.schema["roi_index"].dataType
    ids = to_arrow_type(kind)

    def made(out: list[tuple]) -> pa.RecordBatch:
        types = (ids, pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["roi_index", "width", "height", "channels", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            found = batch.column("found")
            for i in range(batch.num_rows):
                w, h, c = (batch.column(n)[i].as_py() for n in ("width", "height", "channels"))
                px = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8).reshape(h, w, c)
                here = found[i].values
                for j in range(0, len(here), BOXES):
                    some = here[j : j + BOXES].flatten()
                    for roi, *sides in zip(*(x.to_pylist() for x in some), strict=True):
                        x0, y0, x1, y1 = (int(x) for x in sides)
                        a, b, e, f = max(0, x0), max(0, y0), min(w, x1), min(h, y1)
                        part = px[b : max(b, f), a : max(a, e)]
                        out.append((roi, part.shape[1], part.shape[0], c, part.tobytes()))
                        size += part.size
                        if size >= CROP_BYTES or len(out) >= BOXES:
                            yield made(out)
                            out, size = [], 0
        if out:
            yield made(out)
        give_back()

    small_batches(rows.sparkSession)
    found = rows.groupBy("image_path").agg(F.collect_list(F.struct("roi_index", *(F.col(s).cast("double").alias(s) for s in boxes.SIDES))).alias("found"))
    return found.join(pictures, "image_path").select("found", "width", "height", "channels", "data").mapInArrow(run, f"roi_index {kind.simpleString()}, width int, height int, channels int, data binary")


def sharpness_of(data: bytes, width: int, height: int, channels: int) -> float:
    """Variance of the 3x3 Laplacian of the grey picture, its border mirrored; 0 if it is empty."""
    if not width or not height:
        return 0.0
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    grey = px[..., 0] if channels == 1 else np.rint(px[..., 0] * 0.114 + px[..., 1] * 0.587 + px[..., 2] * 0.299)
    g = np.pad(grey, 1, mode="reflect" if min(width, height) > 1 else "edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def sharpness(cut: DataFrame) -> DataFrame:
    small_batches(cut.sparkSession)

    @F.pandas_udf("double")
    def run(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([sharpness_of(*x) for x in zip(data, width, height, channels, strict=True)])

    return cut.select("roi_index", run("data", "width", "height", "channels").alias("sharpness"))
