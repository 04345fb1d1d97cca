"""Counts as the lines of a CSV matrix, however many columns it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.operators import review
from boxwright.operators.mutations import dense_ids
from boxwright.operators.naming import check_unique, csv_text, stem_map
from boxwright.session import cut


def matrix_lines(counts: DataFrame, row: str, column: str, value: str, corner: str) -> DataFrame:
    """nth, line: the header (0), then a line a row; rows and columns by name, 0 where there is no count.

    A null name is an empty one, counts of one cell are summed up, and of no counts there is a header only.
    Columns are numbered by range, and a line is put together from its row's counts and the gaps between
    them: zeros are never rows, names never columns of a table or on the driver. A line holds all
    columns, as the format has it.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = cut(counts.groupBy(name(row).alias("row"), name(column).alias("column")).agg(F.sum(value).alias("n")), "cells")
    columns = cut(dense_ids(cells.select("column").distinct(), ["column"], name="place"), "columns")
    rows = dense_ids(cells.select("row").distinct(), ["row"], name="nth")
    width = columns.count()
    per = cells.join(columns, "column").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("some"))
    before = lambda i: F.when(i == 0, -1).otherwise(F.get("some", i - 1)["place"])
    filled = F.transform("some", lambda x, i: F.concat(F.repeat(F.lit(",0"), x["place"] - before(i) - 1), F.lit(","), x["n"].cast("string")))
    rest = F.repeat(F.lit(",0"), F.lit(width - 1) - F.element_at("some", -1)["place"])
    body = per.join(rows, "row").select((F.col("nth") + 1).cast("bigint").alias("nth"), F.concat(csv_text(F.col("row")), F.array_join(filled, ""), rest).alias("line"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("place", csv_text(F.col("column")).alias("text")))), lambda x: x["text"])
    header = columns.agg(F.concat_ws(",", F.lit(corner), names).alias("line")).select(F.lit(0).cast("bigint").alias("nth"), "line")
    return header.unionByName(body)


def image_label_lines(df: DataFrame, **which) -> DataFrame:
    """``matrix_lines`` of boxes by image and label; an image goes by its name in an export."""
    counts = cut(review.image_label_counts(df, **which), "image-labels")
    return matrix_lines(counts.join(check_unique(stem_map(counts)), "image_path"), "dest", "label", "n", "image")


def taxa_lines(df: DataFrame) -> DataFrame:
    """``matrix_lines`` of all boxes by raw label and bare image name."""
    return matrix_lines(review.taxa_counts(df), "label", "image_name", "n", "taxa")


def write_matrix(lines: DataFrame, path: str) -> None:
    """Text files whose order by name is that of the lines; one file if they are few."""
    lines.repartitionByRange("nth").sortWithinPartitions("nth").select("line").write.text(path)
