"""Box geometry and path parts as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x_min", "y_min", "x_max", "y_max")


def sides(prefix: str = "") -> list[Column]:
    return [F.col(prefix + s).cast("double") for s in SIDES]


def area(box: list[Column]) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def intersection(a: list[Column], b: list[Column]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union, 0 where the union has no area."""
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def overlap_of_smaller(a: list[Column], b: list[Column]) -> Column:
    return intersection(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(1e-9))


def judge_revision(old: list[Column], new: list[Column]) -> Column:
    """'disagrees', 'unchanged' or 'tighter'."""
    inside = intersection(old, new) / F.nullif(area(new), F.lit(0.0))
    flat = (area(old) <= 0) | (area(new) <= 0)
    other = (inside < 0.85) | (area(new) < 0.15 * area(old))
    return F.when(flat, "disagrees").when(iou(old, new) >= 0.95, "unchanged").when(other, "disagrees").otherwise("tighter")


def normalised(width: Column, height: Column) -> list[Column]:
    """Centre and size as fractions of the image: cx, cy, w, h."""
    a, b, c, d = sides()
    return [(a + c) / 2 / width, (b + d) / 2 / height, (c - a) / width, (d - b) / height]


def denormalised(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Corners in pixels from fractions of the image."""
    return [(cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height]


def _limit(x: Column, top: Column) -> Column:
    return F.greatest(F.lit(0), F.least(x, top)).cast("int")


def clamp_import(box: list[Column], width: Column, height: Column) -> list[Column]:
    """Corners in order, rounded half to even, inside the image; a box may be left empty."""
    x0, x1 = F.least(box[0], box[2]), F.greatest(box[0], box[2])
    y0, y1 = F.least(box[1], box[3]), F.greatest(box[1], box[3])
    return [_limit(F.bround(v).cast("int"), top) for v, top in ((x0, width), (y0, height), (x1, width), (y1, height))]


def clamp_video(box: list[Column], width: Column, height: Column) -> list[Column]:
    return [_limit(F.bround(v).cast("int"), top) for v, top in zip(box, (width, height, width, height), strict=True)]


def clamp_edit(box: list[Column], width: Column, height: Column) -> list[Column]:
    """Within the last pixel, and at least one pixel wide and high."""
    x0, y0 = (F.greatest(F.lit(0), F.least(F.bround(v).cast("int"), top - 1)) for v, top in ((box[0], width), (box[1], height)))
    x1, y1 = (F.least(F.greatest(F.bround(v).cast("int"), low + 1), top) for v, low, top in ((box[2], x0, width), (box[3], y0, height)))
    return [x0.cast("int"), y0.cast("int"), x1.cast("int"), y1.cast("int")]


def not_empty(box: list[Column]) -> Column:
    return (box[2] > box[0]) & (box[3] > box[1])


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_parent(path: Column) -> Column:
    """The parent folder's own name, '' at the top."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def stem(name: Column) -> Column:
    """Without the last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(?<=[^/])(\.[^./]+)$", 1)


def frame_name(video: Column, frame: Column) -> Column:
    return F.format_string("%s_frame_%06d", stem(path_name(video)), frame)


def usable_fps(fps: Column) -> Column:
    """A missing, zero or absurd rate counts as 30."""
    return F.when(fps.isNull() | F.isnan(fps) | (fps <= 0) | (fps > 1000), 30.0).otherwise(fps)


def source_of() -> Column:
    """What an image belongs to: its video, else its folder."""
    return F.coalesce(F.col("video_path"), folder(F.col("image_path")))
