"""Detection tables derived from the star schema's ``events`` and ``embeddings``.

The same SQL serves Spark and DuckDB; only the name of the text type differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FRAME = "CAST(floor(event_id / 10.0) AS BIGINT)"
_IMAGE = "lpad(CAST(CASE WHEN fr % 10 < 2 THEN fr - fr % 10 ELSE fr END AS {STR}), 6, '0') || '.png'"
_CLASS = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"

VIEWS = {
    "predictions": f"""
WITH b AS (SELECT event_id AS i, {_FRAME} AS fr, event_type, value, user_id FROM events),
e AS (SELECT b.*, v.embedding AS vec FROM b JOIN embeddings v ON v.vec_id = b.i % 500)
SELECT CAST(i AS INT) AS id, CAST(i AS INT) AS roi_index,
  '/survey/dive_' || CAST(fr % 4 AS {{STR}}) || '/img_' || {_IMAGE} AS image_path,
  'img_' || {_IMAGE} AS image_name,
  CAST((i * 37) % 1800 AS FLOAT) AS x_min, CAST((i * 53) % 1000 AS FLOAT) AS y_min,
  CAST((i * 37) % 1800 + 10 + (i * 7) % 90 AS FLOAT) AS x_max, CAST((i * 53) % 1000 + 10 + (i * 11) % 70 AS FLOAT) AS y_max,
  {_CLASS} AS class_id,
  CASE WHEN i % 50 = 7 THEN NULL ELSE CAST(CAST((i * 17) % 101 AS DOUBLE) / 100 AS FLOAT) END AS confidence,
  event_type AS label,
  CASE WHEN i % 9 = 4 THEN NULL ELSE vec END AS embedding,
  CASE WHEN i % 11 = 0 THEN 'noise' WHEN i % 7 = 0 THEN upper(event_type) WHEN i % 13 = 0 THEN '' ELSE NULL END AS new_label,
  value AS sharpness,
  CASE WHEN i % 5 < 2 THEN 1 WHEN i % 5 = 2 THEN NULL ELSE 0 END AS verified,
  CASE WHEN i % 3 = 0 THEN NULL ELSE '/survey/video_' || CAST(user_id % 5 AS {{STR}}) || '.mp4' END AS video_path,
  CASE WHEN i % 3 = 0 THEN NULL ELSE CAST(fr AS INT) END AS frame_number
FROM e""",
    "fixtures_given": """
SELECT CAST(event_id AS INT) AS roi_index, CAST(user_id % 40 AS INT) AS fixture,
  CASE WHEN event_id % 9 = 4 THEN NULL ELSE CAST((event_id * 29) % 1000 AS DOUBLE) / 1000 END AS typicality
FROM events WHERE event_id % 4 <> 0""",
    "observations": f"""
SELECT '/survey/video_' || CAST(user_id % 5 AS {{STR}}) || '.mp4' AS video_path, CAST(user_id AS INT) AS track_id, CAST(event_id AS INT) AS frame_number,
  CAST((event_id * 37) % 1800 AS FLOAT) AS x_min, CAST((event_id * 53) % 1000 AS FLOAT) AS y_min,
  CAST((event_id * 37) % 1800 + 40 AS FLOAT) AS x_max, CAST((event_id * 53) % 1000 + 30 AS FLOAT) AS y_max,
  CAST(CAST((event_id * 17) % 101 AS DOUBLE) / 100 AS FLOAT) AS confidence, {_CLASS} AS class_id, value AS sharpness
FROM events""",
    "image_sizes": f"""
SELECT DISTINCT '/survey/dive_' || CAST(fr % 4 AS {{STR}}) || '/img_' || {_IMAGE} AS image_path, CAST(1920 AS INT) AS width, CAST(1080 AS INT) AS height
FROM (SELECT {_FRAME} AS fr FROM events) t WHERE fr % 17 <> 3""",
    "box_list": "SELECT CAST(event_id AS INT) AS pos, CAST((event_id * 97) % 1200 AS INT) AS roi_index FROM events WHERE event_id < 200",
    "inventory": f"""
SELECT DISTINCT CASE fr % 4 WHEN 0 THEN '/survey/dive_0/' WHEN 1 THEN '/project/dive_1/' ELSE '/project/survey/dive_2/' END || 'img_' || {_IMAGE} AS path
FROM (SELECT {_FRAME} AS fr FROM events) t WHERE fr % 4 <> 3""",
    "linked_boxes": f"""
WITH b AS (SELECT event_id AS i, event_id % 10 AS slot, {_FRAME} AS fr, event_type FROM events),
g AS (SELECT i, slot, fr % 2 AS cam, CAST(floor(fr / 2.0) AS BIGINT) AS frame, event_type FROM b)
SELECT CAST(i AS INT) AS roi_index, 'cam_' || CAST(cam AS {{STR}}) AS camera, CAST(frame AS INT) AS frame, CAST(slot AS INT) AS slot,
  CAST(CASE WHEN slot = 9 THEN (i * 37) % 1800 ELSE slot * 150 + (frame * (slot + 3)) % 5 END AS FLOAT) AS x_min,
  CAST(CASE WHEN slot = 9 THEN 600 + (i * 53) % 400 ELSE 100 + slot * 20 + (frame * (slot + 1)) % 4 END AS FLOAT) AS y_min,
  CAST(CASE WHEN slot = 9 THEN (i * 37) % 1800 ELSE slot * 150 + (frame * (slot + 3)) % 5 END + 60 AS FLOAT) AS x_max,
  CAST(CASE WHEN slot = 9 THEN 600 + (i * 53) % 400 ELSE 100 + slot * 20 + (frame * (slot + 1)) % 4 END + 50 AS FLOAT) AS y_max,
  CAST(CAST((i * 17) % 101 AS DOUBLE) / 100 AS FLOAT) AS confidence,
  CASE WHEN frame % 13 = 6 THEN event_type ELSE 'slot_' || CAST(slot AS {{STR}}) END AS label,
  CASE WHEN frame % 41 = 5 THEN (slot * 37 + cam * 11 + 203) % 500 ELSE slot * 37 + cam * 11 END AS vec_id
FROM g WHERE slot = 9 OR (frame + slot * 11) % 97 >= 3""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the given folder's Parquet files."""
    for table in ("events", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(VIEWS[name].replace("{STR}", "STRING"))


def oracle(body: str) -> str:
    """DuckDB SQL with the derived tables that it names as common table expressions."""
    used = [n for n in VIEWS if n in body]
    return ("WITH " + ",\n".join(f"{n} AS ({VIEWS[n].replace('{STR}', 'VARCHAR')})" for n in used) + "\n" if used else "") + body
