"""Detector and tracker output as detection rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions import boxes
from boxwright.operators.mutations import append, skip_existing

# The presets' confidence and, for tracks, confidence and least length.
PRESETS = {"curate": (0.005, 0.001, 28), "predict": (0.025, 0.0001, 60)}
STRIDE = 30


def above(detections: DataFrame, preset: str = "curate", confidence: float | None = None) -> DataFrame:
    """Detections of at least the preset's confidence, or of an explicit one."""
    return detections.filter(F.col("confidence").cast("double") >= (PRESETS[preset][0] if confidence is None else confidence))


def long_tracks(tracks: DataFrame, preset: str = "curate", least: int | None = None) -> DataFrame:
    return tracks.filter(F.col("track_length") >= (PRESETS[preset][2] if least is None else least))


def detection_rows(detections: DataFrame, names: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Rows for the table: class names looked up, whole pixels cut (not rounded), empty boxes dropped, unverified."""
    rows = detections.join(F.broadcast(names.select(F.col("idx").alias("class_id"), F.col("name").alias("label"))), "class_id", "left")
    rows = rows.withColumns({s: F.col(s).cast("int").cast("float") for s in boxes.SIDES})
    if sizes is not None:
        rows = rows.join(sizes, "image_path")
        rows = rows.withColumns(dict(zip(boxes.SIDES, (c.cast("float") for c in boxes.clamp_video(boxes.sides(), F.col("width"), F.col("height"))), strict=True))).drop("width", "height")
    rows = rows.filter(boxes.not_empty(boxes.sides()))
    return rows.withColumns({"image_name": boxes.path_name(F.col("image_path")), "verified": F.lit(0), "new_label": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<float>")})


def ingest(table: DataFrame, detections: DataFrame, names: DataFrame, order: list[str], **how) -> DataFrame:
    """Detections appended with ids that continue from the highest."""
    return append(table, detection_rows(detections, names, **how), order)


def stride_rows(observations: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Observations of every ``stride``-th frame as single detections; no track columns."""
    return observations.filter(F.pmod("frame_number", F.lit(stride)) == 0).drop("track_id", "track_length")


def track_majority(observations: DataFrame) -> DataFrame:
    """Per track: most common class (the first seen wins a tie) and number of observations."""
    per = observations.groupBy("video_path", "track_id", "class_id").agg(F.count("*").alias("n"), F.min("frame_number").alias("first"))
    best = F.min_by("class_id", F.struct(-F.col("n"), "first", "class_id")).alias("class_id")
    return per.groupBy("video_path", "track_id").agg(best, F.sum("n").alias("track_length"))


def representatives(observations: DataFrame, mode: str = "best-conf-third", third: str = "middle") -> DataFrame:
    """One observation a track: best-conf, best-conf-third, sharpest-third or center.

    Thirds (first, middle, last) go by frame order; a track of fewer than three
    observations counts whole. Earlier frames win ties.
    """
    keys = ["video_path", "track_id"]
    track = Window.partitionBy(*keys)
    ranked = observations.withColumn("_i", F.row_number().over(track.orderBy("frame_number")) - 1).withColumn("_n", F.count("*").over(track))
    begin, end = {"first": ("0", "_n div 3"), "middle": ("_n div 3", "2 * _n div 3"), "last": ("2 * _n div 3", "_n")}[third]
    inside = (F.col("_n") < 3) | ((F.col("_i") >= F.expr(begin)) & (F.col("_i") < F.expr(end)))
    score = {"best-conf": F.col("confidence"), "best-conf-third": F.col("confidence"), "sharpest-third": F.col("sharpness"), "center": F.when(F.col("_i") == F.expr("_n div 2"), 1).otherwise(0)}[mode]
    kept = ranked.filter(inside) if mode.endswith("third") else ranked
    first = F.row_number().over(track.orderBy(score.desc_nulls_last(), F.col("frame_number")))
    return kept.withColumn("_r", first).filter("_r = 1").drop("_i", "_n", "_r")


def track_rows(observations: DataFrame, mode: str = "best-conf-third", preset: str = "curate", least: int | None = None) -> DataFrame:
    """One row a track, with the majority class and the track's length; observations below the preset's confidence don't count."""
    observations = observations.filter(F.col("confidence").cast("double") >= PRESETS[preset][1])
    best = representatives(observations, mode).drop("class_id").join(track_majority(observations), ["video_path", "track_id"])
    return long_tracks(best, preset, least)


def import_rows(table: DataFrame, rows: DataFrame, verified: bool = True) -> DataFrame:
    """Imported boxes (with image_path, label, corners, confidence, annotation_path, line) appended."""
    fresh = skip_existing(rows.filter("reason is null"), table)
    kept = fresh.withColumns({"image_name": boxes.path_name(F.col("image_path")), "verified": F.lit(int(verified)), "confidence": F.coalesce(F.col("confidence"), F.lit(1.0)).cast("float"), "new_label": F.lit(None).cast("string")})
    return append(table, kept, ["annotation_path", "line"])
