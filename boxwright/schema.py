"""Fixed schemas and their additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The detection table's columns.
PREDICTIONS = (
    "id int, image_name string, image_path string, roi_index int, x_min float, y_min float, x_max float, y_max float, class_id int, confidence float, label string, "
    "embedding array<float>, new_label string, roi binary, sharpness double, verified int, video_path string, frame_number int, frame_time_s double, track_id int, track_length int"
)
RUN_INFO = "model_path string, detected_at timestamp"
FIXTURES = "roi_index int, fixture int, typicality double"
FIXTURE_INFO = "fixture int, rep_roi_index int, n int, first_image string, last_image string"
LATER = ("verified", "video_path", "frame_number", "frame_time_s", "track_id", "track_length")


def fields(ddl: str) -> dict[str, str]:
    return dict(part.strip().split(" ", 1) for part in ddl.split(", "))


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def ensure_column(df: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    return df if has_column(df, name) else df.withColumn(name, F.lit(default).cast(kind))


def ensure_columns(df: DataFrame) -> DataFrame:
    """Columns that later versions added: null, ``verified`` 0."""
    kinds = fields(PREDICTIONS)
    for name in LATER:
        df = ensure_column(df, name, kinds[name], 0 if name == "verified" else None)
    return df


def has_fixtures(tables: object) -> bool:
    """Whether a store has the results of linking, both of its tables."""
    return all(tables.exists(t) for t in ("fixtures", "fixture_info"))


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored detection table, migrated; a clear error where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(f"no detection table at {path}")
    return ensure_columns(spark.read.parquet(path))
