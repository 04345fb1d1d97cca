"""Changes to the detection table, each a DataFrame from a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions import boxes, labels
from boxwright.session import cut


def bulk_update(df: DataFrame, changes: DataFrame, key: str = "roi_index") -> DataFrame:
    """Columns of ``changes`` replace those of matching rows; a change to null is kept as one."""
    cols = [c for c in changes.columns if c != key]
    staged = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in cols), F.lit(True).alias("_hit"))
    joined = df.join(staged, df[key] == F.col("_key"), "left")
    for c in cols:
        joined = joined.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}").cast(df.schema[c].dataType.simpleString())).otherwise(F.col(c)))
    return joined.select(*df.columns)


def _flagged(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col("roi_index").alias("_id")).distinct().withColumn("_hit", F.lit(True)), df["roi_index"] == F.col("_id"), "left")


def label_changes(ids: DataFrame, label: str) -> DataFrame:
    """What ``apply_label`` changes, as keyed values for a stored table: its rows are not written again."""
    return ids.select("roi_index").distinct().select("roi_index", F.lit(label).alias("new_label"), F.lit(1).alias("verified"))


def apply_label(df: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    hit = F.col("_hit")
    rows = _flagged(df, ids)
    return rows.withColumn("new_label", F.when(hit, F.lit(label)).otherwise(F.col("new_label"))).withColumn("verified", F.when(hit, 1).otherwise(F.col("verified"))).select(*df.columns)


def set_verified(df: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    return _flagged(df, ids).withColumn("verified", F.when(F.col("_hit"), int(value)).otherwise(F.col("verified"))).select(*df.columns)


def delete_rois(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("roi_index"), "roi_index", "left_anti").select(*df.columns)


def remap_rules(rules: DataFrame) -> DataFrame:
    """(old_label, new_label) with ``line``: of rules for one label the last counts."""
    return rules.groupBy("old_label").agg(F.max_by("new_label", "line").alias("new_label")) if "line" in rules.columns else rules.dropDuplicates(["old_label"])


def remap_labels(df: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rules at once, so that two labels can be swapped; and (old_label, n) for every rule, 0 where none matched."""
    r = rules.select(F.col("old_label").alias("_old"), F.col("new_label").alias("_to"))
    hits = df.join(r, df["new_label"] == F.col("_old"), "left")
    out = hits.withColumn("new_label", F.coalesce("_to", "new_label")).select(*df.columns)
    counts = rules.join(df.groupBy(F.col("new_label").alias("old_label")).agg(F.count("*").alias("n")), "old_label", "left").select("old_label", "new_label", F.coalesce("n", F.lit(0)).alias("n"))
    return out, counts


def insert_roi(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Hand-drawn boxes (image_path, corners, typed label) as verified rows with the next ids."""
    new = rows.select("image_path", *(F.col(s).cast("float") for s in boxes.SIDES), F.col("label").alias("new_label"), "label", F.lit(1.0).cast("float").alias("confidence"), F.lit(1).alias("verified"))
    return append(df, new, ["image_path", "label", *boxes.SIDES])


def next_rows(df: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows as ``df`` has them, with consecutive ids after its highest, in the given order; missing columns are null."""
    start = df.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("n")).first()["n"]
    numbered = dense_ids(rows, order, start).withColumn("roi_index", F.col("id"))
    have = set(numbered.columns)
    return numbered.select(*((F.col(c) if c in have else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns))


def append(df: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """``df`` and the new rows of ``next_rows``."""
    return df.unionByName(next_rows(df, rows, order))


def dense_ids(rows: DataFrame, order: list[str], start: int = 0, name: str = "id") -> DataFrame:
    """Consecutive ids in an order, without one task for all rows.

    Rows are dealt out by range and written with their part; each part counts
    its own rows, and the counts of the parts before (one row a part) are added.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(dealt.select("*", F.monotonically_increasing_id().alias("_at")), "ids")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], start
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    before = rows.sparkSession.createDataFrame(offsets or [(0, start)], "_part bigint, _before bigint")
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_in")).cast("int")).drop("_part", "_before", "_in", "_at")


def update_bbox(df: DataFrame, changes: DataFrame) -> DataFrame:
    """New boxes (roi_index, corners, optionally roi and sharpness); both vectors become null."""
    vectors = [c for c in ("embedding", "bioclip_embedding") if c in df.columns]
    staged = changes
    for c in vectors:
        staged = staged.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    if "sharpness" in changes.columns:
        staged = staged.withColumn("sharpness", F.col("sharpness"))
    return bulk_update(df, staged)


def set_embedding(df: DataFrame, vectors: DataFrame, column: str = "embedding") -> DataFrame:
    if column not in ("embedding", "bioclip_embedding"):
        raise ValueError(f"not a vector column: {column}")
    return bulk_update(df, vectors.select("roi_index", F.col("vector").alias(column)))


def label_animals(df: DataFrame, fixtures: DataFrame, chosen: DataFrame, relabel: bool = False) -> tuple[DataFrame, DataFrame]:
    """Labels (fixture, lab) for whole animals; returns the table and (verified, relabelled) counts.

    Without ``relabel`` only boxes that already carry the label are verified.
    """
    hits = fixtures.select("roi_index", "fixture").join(chosen, "fixture").join(df, "roi_index")
    differs = ~F.lower(labels.review_label()).eqNullSafe(F.lower("lab"))
    hits = hits.select("roi_index", "lab", differs.alias("differs"))
    if not relabel:
        hits = hits.filter(~F.col("differs"))
    staged = hits.select("roi_index", *([F.col("lab").alias("new_label")] if relabel else []), F.lit(1).alias("verified"))
    return bulk_update(df, staged), hits.agg(F.count("*").alias("n_verified"), F.count_if("differs").alias("n_relabelled"))


def set_animals_verified(df: DataFrame, fixtures: DataFrame, chosen: DataFrame, value: bool = True) -> DataFrame:
    return set_verified(df, fixtures.join(chosen.select("fixture"), "fixture", "left_semi"), value)


def delete_animals(df: DataFrame, fixtures: DataFrame, info: DataFrame, chosen: DataFrame) -> dict[str, DataFrame]:
    """All three tables without some animals, and the ids that went."""
    gone = fixtures.join(chosen.select("fixture").distinct(), "fixture", "left_semi").select("roi_index")
    keep = chosen.select("fixture")
    return {"predictions": delete_rois(df, gone), "fixtures": fixtures.join(keep, "fixture", "left_anti"), "fixture_info": info.join(keep, "fixture", "left_anti"), "gone": gone}


def write_clusters(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """evoc_clust and new_label by roi_index; ``verified`` stays."""
    base = df if "evoc_clust" in df.columns else df.withColumn("evoc_clust", F.lit(None).cast("int"))
    return bulk_update(base, clusters.select("roi_index", F.col("cluster").cast("int").alias("evoc_clust"), F.col("name").alias("new_label")))


def revision_outcomes(df: DataFrame, proposals: DataFrame, single: bool = False) -> DataFrame:
    """roi_index, outcome, apply, new box for proposals (roi_index, old_*, new_*)."""
    p = proposals.join(df.select("roi_index", *boxes.SIDES), "roi_index")
    same: Column = F.lit(True)
    for s in boxes.SIDES:
        same = same & F.col(f"old_{s}").cast("float").eqNullSafe(F.col(s))
    verdict = boxes.judge_revision(boxes.sides("old_"), boxes.sides("new_"))
    outcome = F.when(F.col("new_x_min").isNull(), "nothing").when(~same, "edited").otherwise(verdict)
    applies = F.col("outcome").isin("tighter", *(["disagrees"] if single else []))
    return p.withColumn("outcome", outcome).withColumn("apply", applies).select("roi_index", "outcome", "apply", *(F.col(f"new_{s}").cast("float").alias(s) for s in boxes.SIDES))


def apply_revisions(df: DataFrame, proposals: DataFrame, single: bool = False) -> tuple[DataFrame, DataFrame]:
    found = revision_outcomes(df, proposals, single)
    return update_bbox(df, found.filter("apply").select("roi_index", *boxes.SIDES)), found.groupBy("outcome").agg(F.count("*").alias("n"))


def replace_provenance(run_info: DataFrame, new: DataFrame, only_if_empty: bool = False) -> DataFrame:
    """An ingest replaces the row; an import fills it only where there is none."""
    if not only_if_empty:
        return new
    empty = run_info.agg((F.count("*") == 0).alias("_empty"))
    return run_info.unionByName(new.crossJoin(F.broadcast(empty)).filter("_empty").drop("_empty"))


def skip_existing(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Import rows whose image is in the table already go, and so do later files for an image of the same run."""
    fresh = rows.join(existing.select("image_path").distinct(), "image_path", "left_anti")
    if "annotation_path" not in rows.columns:
        return fresh
    first = fresh.groupBy("image_path").agg(F.min("annotation_path").alias("annotation_path"))
    return fresh.join(first, ["image_path", "annotation_path"], "left_semi")
