"""Counts, pages and lists that a reviewer works from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions import boxes, labels
from boxwright.session import cut

#: Rows up to which a page comes from a top-k.
FRONT = 10_000


def count_rows(df: DataFrame, **filters) -> DataFrame:
    return df.filter(labels.review_filter(**filters)).agg(F.count("*").alias("n"))


def count_verified(df: DataFrame, **filters) -> DataFrame:
    """Both counts, whatever is hidden."""
    filters = {k: v for k, v in filters.items() if not k.startswith("hide_")}
    return df.filter(labels.review_filter(**filters)).agg(F.count_if(labels.verified()).alias("n_verified"), F.count_if(~labels.verified()).alias("n_unverified"))


def hidden_by_confidence(df: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """label, total, hidden; null confidence is hidden as soon as the range is narrowed."""
    shown = F.coalesce(labels.confidence_range(low, high), F.lit(False))
    label = F.coalesce(labels.review_label(), F.lit("(no label)")).alias("label")
    return df.groupBy(label).agg(F.count("*").alias("total"), F.count_if(~shown).alias("hidden")).orderBy(F.desc("hidden"), F.desc("total"), F.lower("label"), "label")


def hidden_summary(hidden: DataFrame) -> DataFrame:
    some = F.col("hidden") > 0
    return hidden.agg(F.sum("total").alias("total"), F.sum("hidden").alias("hidden"), F.count_if(some).alias("classes_hidden"), F.count("*").alias("classes"), F.count_if(F.col("hidden") == F.col("total")).alias("classes_gone"))


def hidden_shares(hidden: DataFrame) -> DataFrame:
    """Per class what is shown, and the hidden share in percent (1 decimal)."""
    return hidden.select("label", (F.col("total") - F.col("hidden")).alias("shown"), F.round(100.0 * F.col("hidden") / F.col("total"), 1).alias("percent_hidden"))


def label_counts(df: DataFrame, exclude_noise: bool = False, require_verified: bool = True, top: int | None = None) -> DataFrame:
    """label, n, percent of all (2 decimals, half to even), most frequent first."""
    kept = df.filter(labels.curated(exclude_noise, require_verified)).groupBy(labels.export_label().alias("label")).agg(F.count("*").alias("n"))
    total = F.broadcast(kept.agg(F.sum("n").alias("_all")))
    out = kept.crossJoin(total).select("label", "n", F.bround(100.0 * F.col("n") / F.col("_all"), 2).alias("percent")).orderBy(F.desc("n"), "label")
    return out.limit(top) if top else out


def boxes_per_image(df: DataFrame, **which) -> DataFrame:
    per = df.filter(labels.curated(**which)).groupBy("image_path").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("images"), F.sum("n").alias("total"), F.round(F.avg("n"), 2).alias("average"), F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"))


def image_label_counts(df: DataFrame, **which) -> DataFrame:
    return df.filter(labels.curated(**which)).groupBy("image_path", labels.export_label().alias("label")).agg(F.count("*").alias("n"))


def pivoted(counts: DataFrame, row: str, column: str, value: str, most: int = 10_000) -> DataFrame:
    """Counts as a matrix, 0 where there are none. The column names are read first; too many are an error."""
    names = [r[0] for r in counts.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"over {most} columns in the matrix")
    return counts.groupBy(row).pivot(column, names).agg(F.sum(value)).fillna(0)


def taxa_counts(df: DataFrame) -> DataFrame:
    """Raw label by bare image name; all rows. Images of one name share a column."""
    return df.groupBy("label", "image_name").agg(F.count("*").alias("n"))


def known_labels(df: DataFrame) -> DataFrame:
    both = df.select(F.col("new_label").alias("label")).union(df.select("label")).distinct()
    return both.filter("label <> ''").orderBy(F.lower("label"), "label")


def effective_labels(df: DataFrame) -> DataFrame:
    return df.select(labels.review_label().alias("label")).distinct().filter("label <> ''").orderBy(F.lower("label"), "label")


def next_id(df: DataFrame) -> DataFrame:
    return df.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("next_id"))


def page(df: DataFrame, sorts: list[tuple[str, bool | None]], offset: int, size: int, **filters) -> DataFrame:
    """``size`` rows from ``offset`` on, with their rank.

    Only ids and sort keys are sorted. Pages near the front come from a bounded
    top-k; for later ones the keys are dealt out by range, and only the parts that
    the page lies in are put in order. The page's rows are then fetched by id; the
    page goes to each task, if it has no more than FRONT rows.
    """
    kept = df.filter(labels.review_filter(**filters))
    order = labels.sort_columns(sorts)
    keys = kept.select("id", *(c for c in ("new_label", "label", "image_name", "sharpness", "confidence", *boxes.SIDES) if c in df.columns))
    first = 0
    if offset + size <= FRONT:
        top = keys.orderBy(*order).limit(offset + size)
    else:
        dealt = cut(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "pages")
        parts, before = [], 0
        for part, n in sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect()):
            if before < offset + size and before + n > offset:
                parts.append((part, before))
            before += n
        first = parts[0][1] if parts else 0
        offset -= first
        top = dealt.filter(F.col("_part").isin([p for p, _ in parts])).drop("_part").orderBy(*order).limit(offset + size)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") > offset)
    ranked = ranked.select("id", (F.col("rank") + first).alias("rank"))
    return df.join(F.broadcast(ranked) if size <= FRONT else ranked, "id").orderBy("rank")


def rois_for_image(df: DataFrame, image_path: str) -> DataFrame:
    return df.filter(F.col("image_path") == image_path).orderBy("id")


def first_of_list(box_list: DataFrame) -> DataFrame:
    """The first place of each box in a list (pos, roi_index, note)."""
    cols = [c for c in box_list.columns if c not in ("roi_index", "pos")]
    return box_list.groupBy("roi_index").agg(F.min("pos").alias("pos"), *(F.min_by(c, "pos").alias(c) for c in cols))


def listed(df: DataFrame, box_list: DataFrame, **filters) -> DataFrame:
    """Rows that a list names and that exist, in its order."""
    return df.filter(labels.review_filter(**filters)).join(first_of_list(box_list), "roi_index").orderBy("pos")


def similarity_pool_size(df: DataFrame, label: str | None = None, mode: str = "effective", **filters) -> DataFrame:
    return df.filter(labels.pool_filter(label, mode, **filters)).agg(F.count("*").alias("n"))


def sources(df: DataFrame) -> DataFrame:
    return df.select(boxes.source_of().alias("source")).distinct()


def embedding_column(df: DataFrame) -> str:
    """The second model's vectors where it has any, else the first's."""
    other = "bioclip_embedding"
    return other if other in df.columns and df.filter(F.col(other).isNotNull()).limit(1).count() else "embedding"


def animal_majority(predictions: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Per fixture: its top label, boxes of it and of all, and how many of both are unverified."""
    rows = fixtures.join(predictions, "roi_index").select("fixture", F.coalesce(labels.review_label(), F.lit("")).alias("lab"), (~labels.verified()).cast("int").alias("open"))
    per = rows.groupBy("fixture", "lab").agg(F.count("*").alias("k"), F.sum("open").alias("k_unverified"))
    first = F.row_number().over(Window.partitionBy("fixture").orderBy(F.desc("k"), "lab"))
    total = Window.partitionBy("fixture")
    out = per.withColumn("n", F.sum("k").over(total)).withColumn("n_unverified", F.sum("k_unverified").over(total)).withColumn("_r", first)
    return out.filter("_r = 1").select("fixture", F.col("lab").alias("label"), "k", "n", "n_unverified", "k_unverified")


def animal_order(majority: DataFrame, search: str | None = None, hide_verified: bool = False, hide_unverified: bool = False) -> DataFrame:
    """Most agreed first. Hiding verified drops confirmed ones, hiding unverified those with nothing verified."""
    out = majority
    if search:
        out = out.filter(F.lower("label").contains(search.lower()))
    if hide_verified:
        out = out.filter("k_unverified > 0")
    if hide_unverified:
        out = out.filter("n_unverified < n")
    return out.orderBy((F.col("n") - F.col("k")).asc(), F.desc("n"), "fixture")


def animal_members(predictions: DataFrame, fixtures: DataFrame, fixture: int, **filters) -> DataFrame:
    rows = fixtures.filter(F.col("fixture") == fixture).join(predictions.filter(labels.review_filter(**filters)), "roi_index")
    return rows.orderBy(F.col("typicality").asc_nulls_last(), "roi_index")


def adhoc(spark, statement: str, limit: int = 50, **tables: DataFrame) -> tuple[DataFrame, int]:
    """First rows of a statement over named tables, and how many more there are; it runs again only to count those."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(statement)
    rows = out.limit(limit + 1).collect()
    return spark.createDataFrame(rows[:limit], out.schema), 0 if len(rows) <= limit else out.count() - limit
