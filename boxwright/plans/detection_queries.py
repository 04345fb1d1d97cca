"""Queries over the detection tables, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright import schema
from boxwright.functions import boxes, labels
from boxwright.functions.quantiles import quantiles
from boxwright.operators import clustering, linking, matrices, mutations, naming, ranking, review, vectors
from boxwright.plans.fixture_views import oracle, view
from boxwright.session import scratch_path
from boxwright.sources import detections as det
from boxwright.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EXPORT = "coalesce(new_label, label)"
REVIEW = "coalesce(nullif(new_label, ''), label)"
OPEN = "(verified IS NULL OR verified <> 1)"
CURATED = f"verified = 1 AND {EXPORT} IS NOT NULL AND {EXPORT} <> 'noise'"
BOX = "CAST(x_min AS DOUBLE) AS x_min, CAST(y_min AS DOUBLE) AS y_min, CAST(x_max AS DOUBLE) AS x_max, CAST(y_max AS DOUBLE) AS y_max"
TABLE = ["id", "label", "new_label", "verified"]
RULES = [("noise", "view"), ("VIEW", "CLICK"), ("CLICK", "VIEW"), ("absent", "x")]
NAMES = [(0, "view"), (1, "zebra"), (2, "click")]
PINS = [("img_000005",), ("/survey/dive_2/img_000022.png",)]
CLASS_NAMES = [(0, "click"), (1, "error"), (2, "purchase"), (3, "signup"), (4, "view")]


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = oracle(sql)
        return f

    return add


def pred(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "predictions")


def box_columns(prefix: str = "") -> list:
    return [F.col(prefix + s).cast("double").alias(s) for s in boxes.SIDES]


def small(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


# Labels, predicates, geometry


@query(f"SELECT id, {EXPORT} AS lab FROM predictions")
def effective_label_export(spark, sf):
    return pred(spark, sf).select("id", labels.export_label().alias("lab"))


@query(f"SELECT id, {REVIEW} AS lab FROM predictions")
def effective_label_review(spark, sf):
    return pred(spark, sf).select("id", labels.review_label().alias("lab"))


@query(f"SELECT id, {EXPORT} AS lab FROM predictions WHERE {CURATED}")
def curated_rows(spark, sf):
    return pred(spark, sf).filter(labels.curated()).select("id", labels.export_label().alias("lab"))


@query("SELECT id FROM predictions WHERE CAST(confidence AS DOUBLE) >= 0.3 - 1e-6 AND CAST(confidence AS DOUBLE) <= 0.7 + 1e-6")
def confidence_range(spark, sf):
    return pred(spark, sf).filter(labels.confidence_range(0.3, 0.7)).select("id")


@query(f"SELECT id, {REVIEW} AS lab FROM predictions WHERE {REVIEW} = 'click' AND {OPEN} AND CAST(confidence AS DOUBLE) >= 0.2 - 1e-6")
def review_filter(spark, sf):
    return pred(spark, sf).filter(labels.review_filter("click", hide_verified=True, low=0.2)).select("id", labels.review_label().alias("lab"))


@query("SELECT id, CAST(x_max - x_min AS DOUBLE) / nullif(CAST(y_max - y_min AS DOUBLE), 0) AS aspect, CAST(x_max - x_min AS DOUBLE) * CAST(y_max - y_min AS DOUBLE) AS size FROM predictions")
def box_geometry(spark, sf):
    return pred(spark, sf).select("id", labels.SORTS["Aspect Ratio"][0]().alias("aspect"), labels.SORTS["Box Size"][0]().alias("size"))


_PAIRS = f"""SELECT a.id AS a, b.id AS b, ix * iy AS inter, aa, ab FROM (SELECT id, image_path, {BOX} FROM predictions) a JOIN (SELECT id, image_path, {BOX} FROM predictions) b
 ON a.image_path = b.image_path AND a.id < b.id, LATERAL (SELECT greatest(least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min), 0) AS ix, greatest(least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min), 0) AS iy,
 (a.x_max - a.x_min) * (a.y_max - a.y_min) AS aa, (b.x_max - b.x_min) * (b.y_max - b.y_min) AS ab)"""


@query(f"SELECT a, b, round(inter / (aa + ab - inter), 6) AS iou, round(inter / greatest(least(aa, ab), 1e-9), 6) AS of_smaller FROM ({_PAIRS}) WHERE inter > 0")
def box_iou(spark, sf):
    p = pred(spark, sf)
    one, two = (p.select(F.col("id").alias(x), "image_path", *(F.col(s).cast("double").alias(f"{x}_{s}") for s in boxes.SIDES)) for x in "ab")
    a, b = (([F.col(f"{x}_{s}") for s in boxes.SIDES]) for x in "ab")
    met = one.join(two, "image_path").filter("a < b").filter(boxes.intersection(a, b) > 0)
    return met.select("a", "b", F.round(boxes.iou(a, b), 6).alias("iou"), F.round(boxes.overlap_of_smaller(a, b), 6).alias("of_smaller"))


@query("""SELECT id, CASE WHEN nx1 <= nx0 OR ny1 <= ny0 THEN 'disagrees' WHEN inter / (ao + an - inter) >= 0.95 THEN 'unchanged' WHEN inter / an < 0.85 OR an < 0.15 * ao THEN 'disagrees' ELSE 'tighter' END AS verdict
 FROM (SELECT *, (nx1 - nx0) * (ny1 - ny0) AS an, greatest(least(x1, nx1) - greatest(x0, nx0), 0) * greatest(least(y1, ny1) - greatest(y0, ny0), 0) AS inter, (x1 - x0) * (y1 - y0) AS ao
 FROM (SELECT id, CAST(x_min AS DOUBLE) AS x0, CAST(y_min AS DOUBLE) AS y0, CAST(x_max AS DOUBLE) AS x1, CAST(y_max AS DOUBLE) AS y1, CAST(x_min AS DOUBLE) + id % 12 AS nx0, CAST(y_min AS DOUBLE) + id % 3 AS ny0, CAST(x_max AS DOUBLE) - id % 7 AS nx1, CAST(y_max AS DOUBLE) + id % 5 AS ny1 FROM predictions))""")
def judge_revision(spark, sf):
    a = boxes.sides()
    i = F.col("id")
    return pred(spark, sf).select("id", boxes.judge_revision(a, [a[0] + i % 12, a[1] + i % 3, a[2] - i % 7, a[3] + i % 5]).alias("verdict"))


@query("SELECT id, round((CAST(x_min AS DOUBLE) + CAST(x_max AS DOUBLE)) / 2 / 1920, 6) AS cx, round((CAST(y_min AS DOUBLE) + CAST(y_max AS DOUBLE)) / 2 / 1080, 6) AS cy, round(CAST(x_max - x_min AS DOUBLE) / 1920, 6) AS w, round(CAST(y_max - y_min AS DOUBLE) / 1080, 6) AS h FROM predictions")
def yolo_normalise(spark, sf):
    cols = boxes.normalised(F.lit(1920), F.lit(1080))
    return pred(spark, sf).select("id", *(F.round(c, 6).alias(n) for c, n in zip(cols, ("cx", "cy", "w", "h"), strict=True)))


@query("""SELECT id, CAST(greatest(0, least(round_even(least(x0, x1), 0), 1500)) AS INT) AS x_min, CAST(greatest(0, least(round_even(least(y0, y1), 0), 900)) AS INT) AS y_min, CAST(greatest(0, least(round_even(greatest(x0, x1), 0), 1500)) AS INT) AS x_max, CAST(greatest(0, least(round_even(greatest(y0, y1), 0), 900)) AS INT) AS y_max
 FROM (SELECT id, CAST(x_max AS DOUBLE) + 0.5 AS x0, CAST(y_min AS DOUBLE) - 20.5 AS y0, CAST(x_min AS DOUBLE) - 0.5 AS x1, CAST(y_max AS DOUBLE) AS y1 FROM predictions)""")
def pixel_clamp(spark, sf):
    a = boxes.sides()
    new = boxes.clamp_import([a[2] + 0.5, a[1] - 20.5, a[0] - 0.5, a[3]], F.lit(1500), F.lit(900))
    return pred(spark, sf).select("id", *(c.alias(s) for c, s in zip(new, boxes.SIDES, strict=True)))


_ID_ROWS = f"""SELECT image_path, CAST(row_number() OVER (PARTITION BY image_path ORDER BY id) - 1 AS INT) AS "index", lab AS label, conf AS confidence, CAST(floor((l + r) / 2.0) AS INT) AS center_x, CAST(floor((t + b) / 2.0) AS INT) AS center_y, l AS tl_x, t AS tl_y, r AS br_x, b AS br_y
 FROM (SELECT id, image_path, {EXPORT} AS lab, printf('%.4f', CAST(confidence AS DOUBLE)) AS conf, CAST(round_even(x_min, 0) AS INT) AS l, CAST(round_even(y_min, 0) AS INT) AS t, CAST(round_even(x_max, 0) AS INT) AS r, CAST(round_even(y_max, 0) AS INT) AS b FROM predictions WHERE {CURATED} AND confidence IS NOT NULL)"""


@query(_ID_ROWS)
def id_rows(spark, sf):
    return naming.id_rows(pred(spark, sf).filter(labels.curated()).filter("confidence is not null"))


@query(f"""SELECT image_path, count(*) AS n FROM predictions WHERE {EXPORT} IS NOT NULL AND image_path NOT IN (SELECT image_path FROM predictions WHERE {EXPORT} IS NOT NULL AND {OPEN} AND (confidence IS NULL OR CAST(confidence AS DOUBLE) < 0.05)) GROUP BY image_path""")
def confident_images(spark, sf):
    rows = pred(spark, sf).filter(labels.curated(exclude_noise=False, require_verified=False))
    return naming.confident_images(rows, 5).groupBy("image_path").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT coalesce(video_path, regexp_replace(image_path, '/[^/]*$', '')) AS source FROM predictions")
def sources(spark, sf):
    return review.sources(pred(spark, sf))


@query("SELECT id, lpad(CAST(id % 1000 AS VARCHAR), 6, '0') AS digits, 'video_1_frame_' || lpad(CAST(id % 1000 AS VARCHAR), 6, '0') AS name, id / 30.0 AS seconds FROM predictions")
def frame_names(spark, sf):
    n = F.col("id") % 1000
    return pred(spark, sf).select("id", F.lpad(n.cast("string"), 6, "0").alias("digits"), boxes.frame_name(F.lit("/survey/video_1.mp4"), n).alias("name"), (F.col("id") / boxes.usable_fps(F.lit(5000.0))).alias("seconds"))


@query("SELECT 'embedding' AS chosen, count(embedding) AS n FROM predictions")
def embedding_column(spark, sf):
    p = pred(spark, sf).withColumn("bioclip_embedding", F.lit(None).cast("array<float>"))
    c = review.embedding_column(p)
    return p.agg(F.lit(c).alias("chosen"), F.count(c).alias("n"))


# Counts


@query(f"SELECT count(*) AS n FROM predictions WHERE {REVIEW} = 'view' AND {OPEN}")
def count_rows(spark, sf):
    return review.count_rows(pred(spark, sf), label="view", hide_verified=True)


@query(f"SELECT count(*) FILTER (WHERE verified = 1) AS n_verified, count(*) FILTER (WHERE {OPEN}) AS n_unverified FROM predictions WHERE {REVIEW} = 'view'")
def count_verified(spark, sf):
    return review.count_verified(pred(spark, sf), label="view", hide_verified=True)


_HIDDEN = f"SELECT coalesce({REVIEW}, '(no label)') AS label, count(*) AS total, count(*) FILTER (WHERE NOT coalesce(CAST(confidence AS DOUBLE) >= 0.4 - 1e-6, false)) AS hidden FROM predictions GROUP BY 1"


@query(_HIDDEN)
def hidden_by_confidence(spark, sf):
    return review.hidden_by_confidence(pred(spark, sf), 0.4, 1.0)


@query(f"SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(hidden) AS BIGINT) AS hidden, count(*) FILTER (WHERE hidden > 0) AS classes_hidden, count(*) AS classes, count(*) FILTER (WHERE hidden = total) AS classes_gone FROM ({_HIDDEN})")
def hidden_summary(spark, sf):
    return review.hidden_summary(review.hidden_by_confidence(pred(spark, sf), 0.4, 1.0))


@query(f"SELECT label, n, CAST(q + CASE WHEN 2 * r > t OR (2 * r = t AND q % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100 AS percent FROM (SELECT lab AS label, n, 10000 * n // sum(n) OVER () AS q, 10000 * n % sum(n) OVER () AS r, sum(n) OVER () AS t FROM (SELECT {EXPORT} AS lab, count(*) AS n FROM predictions WHERE verified = 1 AND {EXPORT} IS NOT NULL GROUP BY 1))")
def label_counts(spark, sf):
    return review.label_counts(pred(spark, sf))


@query(f"SELECT count(*) AS images, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 2) AS average, min(n) AS least, CAST(median(n) AS DOUBLE) AS median, max(n) AS most FROM (SELECT image_path, count(*) AS n FROM predictions WHERE {CURATED} GROUP BY 1)")
def boxes_per_image(spark, sf):
    return review.boxes_per_image(pred(spark, sf))


_IMAGE_LABELS = f"SELECT image_path, {EXPORT} AS label, count(*) AS n FROM predictions WHERE {CURATED} GROUP BY 1, 2"


@query(_IMAGE_LABELS)
def image_label_counts(spark, sf):
    return review.image_label_counts(pred(spark, sf))


@query(f"""SELECT image_path AS image, {', '.join(f"CAST(coalesce(sum(n) FILTER (WHERE label = '{x}'), 0) AS BIGINT) AS {n}" for x, n in (('click', 'n_click'), ('CLICK', 'n_upper_click'), ('error', 'n_error'), ('view', 'n_view')))} FROM ({_IMAGE_LABELS}) GROUP BY 1""")
def image_label_matrix(spark, sf):
    counts = review.image_label_counts(pred(spark, sf)).withColumn("image", F.col("image_path")).withColumn("key", F.when(F.col("label") == F.upper("label"), F.concat(F.lit("upper_"), F.lower("label"))).otherwise(F.col("label")))
    wide = review.pivoted(counts, "image", "key", "n")
    return wide.select("image", *(F.col(c).alias(f"n_{c}") for c in ("click", "upper_click", "error", "view")))


@query("SELECT label, image_name, count(*) AS n FROM predictions GROUP BY 1, 2")
def taxa_matrix(spark, sf):
    return review.taxa_counts(pred(spark, sf))


@query("SELECT DISTINCT label FROM (SELECT new_label AS label FROM predictions UNION ALL SELECT label FROM predictions) WHERE label <> ''")
def known_labels(spark, sf):
    return review.known_labels(pred(spark, sf))


@query(f"SELECT DISTINCT {REVIEW} AS label FROM predictions WHERE {REVIEW} <> ''")
def effective_labels(spark, sf):
    return review.effective_labels(pred(spark, sf))


@query(f"SELECT count(*) AS n FROM predictions WHERE label = 'click' AND {OPEN}")
def similarity_pool(spark, sf):
    return review.similarity_pool_size(pred(spark, sf), "click", "original", hide_verified=True)


@query("SELECT coalesce(max(id), -1) + 1 AS next_id FROM predictions")
def next_id(spark, sf):
    return review.next_id(pred(spark, sf))


@query("SELECT unnest(CAST([0.0, 0.1, 0.5, 0.777, 0.95, 1.0] AS DOUBLE[])) AS share, unnest(quantile_cont(sharpness, [0.0, 0.1, 0.5, 0.777, 0.95, 1.0])) AS value FROM predictions")
def sharpness_quantiles(spark, sf):
    shares = [0.0, 0.1, 0.5, 0.777, 0.95, 1.0]
    return small(spark, list(zip(shares, quantiles(pred(spark, sf), "sharpness", shares), strict=True)), "share double, value double")


# Pages and lists


@query("SELECT id, CAST(row_number() OVER (ORDER BY sharpness DESC NULLS LAST, id) AS INT) AS rank FROM predictions QUALIFY rank > 40 AND rank <= 90")
def page(spark, sf):
    return review.page(pred(spark, sf), [("Sharpness", None)], 40, 50).select("id", "rank")


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY new_label ASC NULLS LAST, CAST(x_max - x_min AS DOUBLE) * CAST(y_max - y_min AS DOUBLE) DESC NULLS LAST, id) AS INT) AS rank FROM predictions WHERE {OPEN} QUALIFY rank > 100 AND rank <= 200")
def stacked_sort_page(spark, sf):
    return review.page(pred(spark, sf), [("New Label", None), ("Box Size", True)], 100, 100, hide_verified=True).select("id", "rank")


@query("SELECT id FROM predictions WHERE image_path = '/survey/dive_2/img_000022.png'")
def rois_for_image(spark, sf):
    return review.rois_for_image(pred(spark, sf), "/survey/dive_2/img_000022.png").select("id")


@query("SELECT roi_index, min(pos) AS pos FROM box_list JOIN predictions USING (roi_index) GROUP BY 1")
def box_list(spark, sf):
    return review.listed(pred(spark, sf), view(spark, sf, "box_list")).select("roi_index", "pos")


# Names and exports

_STEMS = """SELECT image_path, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN parent || '_' || stem ELSE stem END AS dest
 FROM (SELECT DISTINCT image_path, regexp_extract(image_path, '([^/]+)\\.[^./]+$', 1) AS stem, regexp_extract(image_path, '([^/]+)/[^/]+$', 1) AS parent FROM predictions)"""


@query(_STEMS)
def stem_map(spark, sf):
    return naming.stem_map(pred(spark, sf))


@query(f"SELECT image_path AS source_path, dest || '.png' AS dest_filename FROM ({_STEMS})")
def manifest(spark, sf):
    return naming.manifest(pred(spark, sf))


_CLASSES = f"SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INT) AS idx FROM (SELECT DISTINCT {EXPORT} AS name FROM predictions WHERE {CURATED})"


@query(f"""SELECT p.id, printf('%d %.6f %.6f %.6f %.6f', c.idx, (CAST(x_min AS DOUBLE) + CAST(x_max AS DOUBLE)) / 2 / width, (CAST(y_min AS DOUBLE) + CAST(y_max AS DOUBLE)) / 2 / height, (CAST(x_max AS DOUBLE) - CAST(x_min AS DOUBLE)) / width, (CAST(y_max AS DOUBLE) - CAST(y_min AS DOUBLE)) / height) AS line
 FROM predictions p JOIN image_sizes USING (image_path) JOIN ({_CLASSES}) c ON c.name = {EXPORT} WHERE {CURATED}""")
def yolo_label_lines(spark, sf):
    rows = pred(spark, sf).filter(labels.curated())
    classes = naming.class_table(rows.withColumn("label", labels.export_label()))
    lines = naming.yolo_rows(rows, view(spark, sf, "image_sizes"), classes)
    return lines.select("id", naming.yolo_line().alias("line"))


@query(f"""SELECT * FROM (VALUES (0, 'view'), (1, 'zebra'), (2, 'click')) t(idx, name) UNION ALL
 SELECT CAST(2 + row_number() OVER (ORDER BY name) AS INT), name FROM ({_CLASSES}) WHERE name NOT IN ('view', 'zebra', 'click')""")
def class_names(spark, sf):
    rows = pred(spark, sf).filter(labels.curated()).select(labels.export_label().alias("label"))
    return naming.class_table(rows, small(spark, NAMES, "idx int, name string"))


#: Every row against every column, as text.
_LINES = """SELECT CAST(0 AS BIGINT) AS nth, '{corner},' || string_agg(c, ',' ORDER BY c) AS line FROM (SELECT DISTINCT c FROM cells)
 UNION ALL SELECT row_number() OVER (ORDER BY r), r || ',' || string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY c) FROM (SELECT DISTINCT r FROM cells) CROSS JOIN (SELECT DISTINCT c FROM cells) LEFT JOIN cells USING (r, c) GROUP BY r"""


@query()
def image_label_lines(spark, sf):
    return matrices.image_label_lines(pred(spark, sf))


@query()
def taxa_lines(spark, sf):
    return matrices.taxa_lines(pred(spark, sf))


def _assigned(spark, sf):
    images = naming.stem_map(pred(spark, sf).join(view(spark, sf, "image_sizes"), "image_path", "left_semi"))
    return naming.splits(images, 70, 20, 10, 7, small(spark, PINS, "name string"))


@query()
def splits(spark, sf):
    return _assigned(spark, sf).select("image_path", "split")


@query("""SELECT split, n FROM (SELECT count(DISTINCT image_path) AS k FROM predictions JOIN image_sizes USING (image_path)), LATERAL (SELECT 'test' AS split, CAST(k * 10 // 100 AS BIGINT) AS n UNION ALL SELECT 'val', CAST(k * 20 // 100 AS BIGINT) UNION ALL SELECT 'train', CAST(k - k * 10 // 100 - k * 20 // 100 AS BIGINT))""")
def split_counts(spark, sf):
    return _assigned(spark, sf).groupBy("split").agg(F.count("*").alias("n"))


@query()
def split_lists(spark, sf):
    return naming.split_lists(_assigned(spark, sf))


@query(f"SELECT image_path FROM ({_STEMS}) WHERE dest = 'img_000005' OR image_path = '/survey/dive_2/img_000022.png'")
def pinned_images(spark, sf):
    return naming.pinned_images(naming.stem_map(pred(spark, sf)), small(spark, PINS, "name string"))


@query(f"SELECT DISTINCT {EXPORT} AS label FROM predictions WHERE {CURATED}")
def voc_names(spark, sf):
    return pred(spark, sf).filter(labels.curated()).select(labels.export_label().alias("label")).distinct()


@query(f"SELECT id, {EXPORT} AS name, CAST(trunc(x_min) AS INT) AS xmin, CAST(trunc(y_min) AS INT) AS ymin, CAST(trunc(x_max) AS INT) AS xmax, CAST(trunc(y_max) AS INT) AS ymax FROM predictions JOIN image_sizes USING (image_path) WHERE {CURATED}")
def voc_objects(spark, sf):
    return naming.voc_objects(pred(spark, sf).filter(labels.curated()), view(spark, sf, "image_sizes")).select("id", "name", "xmin", "ymin", "xmax", "ymax")


@query("""SELECT image_path, CAST((dense_rank() OVER (ORDER BY image_path) - 1) // 250 AS INT) AS page, count(*) AS n
 FROM (SELECT DISTINCT image_path, x_min, y_min, x_max, y_max, coalesce(new_label, label) AS label FROM predictions WHERE verified = 1 AND coalesce(new_label, label) IS NOT NULL) GROUP BY image_path""")
def gallery_pages(spark, sf):
    crops = naming.gallery_rows(pred(spark, sf).filter(labels.curated(exclude_noise=False)))
    return crops.groupBy("image_path", "page").agg(F.count("*").alias("n"))


# Changes


@query("SELECT id FROM predictions WHERE image_path NOT IN (SELECT image_path FROM image_sizes)")
def skip_existing(spark, sf):
    return mutations.skip_existing(pred(spark, sf), view(spark, sf, "image_sizes")).select("id")


@query("SELECT id, CASE new_label WHEN 'noise' THEN 'view' WHEN 'VIEW' THEN 'CLICK' WHEN 'CLICK' THEN 'VIEW' ELSE new_label END AS new_label FROM predictions")
def remap_labels(spark, sf):
    return mutations.remap_labels(pred(spark, sf), small(spark, RULES, "old_label string, new_label string"))[0].select("id", "new_label")


@query("SELECT o AS old_label, t AS new_label, count(p.id) AS n FROM (VALUES ('noise', 'view'), ('VIEW', 'CLICK'), ('CLICK', 'VIEW'), ('absent', 'x')) r(o, t) LEFT JOIN predictions p ON p.new_label = r.o GROUP BY 1, 2")
def remap_counts(spark, sf):
    return mutations.remap_labels(pred(spark, sf), small(spark, RULES, "old_label string, new_label string"))[1]


_LISTED = "roi_index IN (SELECT roi_index FROM box_list)"


@query(f"SELECT id, CASE WHEN {_LISTED} THEN 'crab' ELSE new_label END AS new_label, CASE WHEN {_LISTED} THEN 1 ELSE verified END AS verified FROM predictions")
def apply_label(spark, sf):
    return mutations.apply_label(pred(spark, sf), view(spark, sf, "box_list"), "crab").select("id", "new_label", "verified")


@query(f"SELECT id, CASE WHEN {_LISTED} THEN 0 ELSE verified END AS verified FROM predictions")
def set_verified(spark, sf):
    return mutations.set_verified(pred(spark, sf), view(spark, sf, "box_list"), False).select("id", "verified")


@query(f"SELECT id FROM predictions WHERE NOT {_LISTED}")
def delete_rois(spark, sf):
    return mutations.delete_rois(pred(spark, sf), view(spark, sf, "box_list")).select("id")


@query("SELECT p.id, CASE WHEN f.roi_index IS NULL THEN p.sharpness ELSE f.typicality END AS sharpness FROM predictions p LEFT JOIN fixtures_given f USING (roi_index)")
def bulk_update(spark, sf):
    return mutations.bulk_update(pred(spark, sf), view(spark, sf, "fixtures_given").select("roi_index", F.col("typicality").alias("sharpness"))).select("id", "sharpness")


@query("""SELECT id, label, new_label, verified FROM predictions UNION ALL
 SELECT CAST((SELECT max(id) FROM predictions) + row_number() OVER (ORDER BY image_path, label, x_min, y_min, x_max, y_max) AS INT), label, label, 1 FROM (SELECT image_path, 'drawn' AS label, CAST(0 AS FLOAT) AS x_min, CAST(0 AS FLOAT) AS y_min, CAST(width AS FLOAT) AS x_max, CAST(height AS FLOAT) AS y_max FROM image_sizes)""")
def insert_roi(spark, sf):
    new = view(spark, sf, "image_sizes").select("image_path", F.lit("drawn").alias("label"), F.lit(0).alias("x_min"), F.lit(0).alias("y_min"), F.col("width").alias("x_max"), F.col("height").alias("y_max"))
    return mutations.insert_roi(pred(spark, sf), new).select(*TABLE)


@query("SELECT p.id, CAST(CASE WHEN b.roi_index IS NULL THEN p.x_min ELSE 1 END AS DOUBLE) AS x_min, CAST(CASE WHEN b.roi_index IS NULL THEN p.y_max ELSE 9 END AS DOUBLE) AS y_max, b.roi_index IS NULL AND p.embedding IS NOT NULL AS has_vector FROM predictions p LEFT JOIN (SELECT DISTINCT roi_index FROM box_list) b USING (roi_index)")
def update_bbox(spark, sf):
    changes = view(spark, sf, "box_list").select("roi_index").distinct().select("roi_index", F.lit(1).alias("x_min"), F.lit(2).alias("y_min"), F.lit(8).alias("x_max"), F.lit(9).alias("y_max"))
    return mutations.update_bbox(pred(spark, sf), changes).select("id", F.col("x_min").cast("double").alias("x_min"), F.col("y_max").cast("double").alias("y_max"), F.col("embedding").isNotNull().alias("has_vector"))


@query("SELECT p.id, CASE WHEN b.roi_index IS NULL THEN len(p.embedding) ELSE 2 END AS dims FROM predictions p LEFT JOIN (SELECT DISTINCT roi_index FROM box_list) b USING (roi_index) WHERE p.embedding IS NOT NULL OR b.roi_index IS NOT NULL")
def set_embedding(spark, sf):
    new = view(spark, sf, "box_list").select("roi_index", F.array(F.lit(1.0), F.lit(2.0)).alias("vector")).dropDuplicates(["roi_index"])
    return mutations.set_embedding(pred(spark, sf), new).filter("embedding is not null").select("id", F.size("embedding").cast("bigint").alias("dims"))


_OBS = "SELECT *, row_number() OVER (ORDER BY video_path, frame_number) AS k FROM observations"


@query(f"SELECT id FROM predictions UNION ALL SELECT CAST((SELECT max(id) FROM predictions) + k AS INT) FROM ({_OBS})")
def append_ids(spark, sf):
    rows = view(spark, sf, "observations").withColumn("image_path", F.col("video_path"))
    return mutations.append(pred(spark, sf), rows, ["video_path", "frame_number"]).select("id")


@query("SELECT roi_index, new_label, verified FROM (SELECT p.roi_index, CASE WHEN hit THEN 'crab' ELSE new_label END AS new_label, CASE WHEN hit THEN 1 ELSE verified END AS verified FROM (SELECT p.*, f.fixture IS NOT NULL AND f.fixture < 5 AS hit FROM predictions p LEFT JOIN fixtures_given f USING (roi_index)) p)")
def label_animals(spark, sf):
    p, fx = pred(spark, sf), view(spark, sf, "fixtures_given")
    chosen = fx.filter("fixture < 5").select("fixture").distinct().withColumn("lab", F.lit("crab"))
    return mutations.label_animals(p, fx, chosen, relabel=True)[0].select("roi_index", "new_label", "verified")


@query(f"SELECT count(*) AS n_verified, count(*) FILTER (WHERE lower({REVIEW}) IS DISTINCT FROM 'click') AS n_relabelled FROM fixtures_given JOIN predictions USING (roi_index) WHERE fixture < 5")
def label_animal_counts(spark, sf):
    fx = view(spark, sf, "fixtures_given")
    chosen = fx.filter("fixture < 5").select("fixture").distinct().withColumn("lab", F.lit("click"))
    return mutations.label_animals(pred(spark, sf), fx, chosen, relabel=True)[1]


@query("SELECT id, CASE WHEN roi_index IN (SELECT roi_index FROM fixtures_given WHERE fixture = 7) THEN 1 ELSE verified END AS verified FROM predictions")
def set_animals_verified(spark, sf):
    fx = view(spark, sf, "fixtures_given")
    return mutations.set_animals_verified(pred(spark, sf), fx, fx.filter("fixture = 7").select("fixture").distinct()).select("id", "verified")


@query("SELECT id FROM predictions WHERE roi_index NOT IN (SELECT roi_index FROM fixtures_given WHERE fixture < 3)")
def delete_animals(spark, sf):
    fx = view(spark, sf, "fixtures_given")
    info = fx.groupBy("fixture").agg(F.count("*").alias("n"))
    return mutations.delete_animals(pred(spark, sf), fx, info, fx.filter("fixture < 3").select("fixture").distinct())["predictions"].select("id")


@query("SELECT roi_index, CAST(roi_index % 6 - 1 AS INT) AS evoc_clust, 'c' || CAST(roi_index % 6 AS VARCHAR) AS new_label, verified FROM predictions")
def write_clusters(spark, sf):
    p = pred(spark, sf)
    given = p.select("roi_index", (F.col("roi_index") % 6 - 1).alias("cluster"), F.concat(F.lit("c"), (F.col("roi_index") % 6).cast("string")).alias("name"))
    return mutations.write_clusters(p, given).select("roi_index", "evoc_clust", "new_label", "verified")


@query("SELECT id, verified, track_id FROM (SELECT id, 0 AS verified, CAST(NULL AS INT) AS track_id FROM predictions)")
def migrate_schema(spark, sf):
    old = pred(spark, sf).drop("verified", "video_path", "frame_number")
    return schema.ensure_columns(old).select("id", "verified", "track_id")


@query("SELECT 'model_' || CAST(count(*) AS VARCHAR) AS model_path FROM predictions")
def provenance(spark, sf):
    new = pred(spark, sf).agg(F.concat(F.lit("model_"), F.count("*").cast("string")).alias("model_path"))
    return mutations.replace_provenance(new.limit(0), new, only_if_empty=True)


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE roi_index % 5 WHEN 0 THEN 'nothing' WHEN 1 THEN 'edited' WHEN 2 THEN 'unchanged' WHEN 3 THEN 'disagrees' ELSE 'tighter' END AS outcome FROM predictions) GROUP BY 1")
def apply_revisions(spark, sf):
    i = F.col("roi_index") % 5
    p = pred(spark, sf)
    old = [(F.col(s) + F.when(i == 1, 1).otherwise(0)).alias(f"old_{s}") for s in boxes.SIDES]
    smaller = {"x_max": (F.col("x_max") - F.col("x_min")) / 4}
    new = [F.when(i != 0, F.col(s) + F.when(i == 3, 500).otherwise(0) - F.when(i == 4, smaller.get(s, F.lit(0))).otherwise(0)).alias(f"new_{s}") for s in boxes.SIDES]
    return mutations.apply_revisions(p, p.select("roi_index", *old, *new))[1]


@query("SELECT id, CAST(x_max - CASE WHEN roi_index % 5 = 4 THEN (x_max - x_min) / 4 ELSE 0 END AS DOUBLE) AS x_max, embedding IS NOT NULL AND roi_index % 5 <> 4 AS has_vector FROM predictions")
def tighter_boxes(spark, sf):
    p = pred(spark, sf)
    old = [F.col(s).alias(f"old_{s}") for s in boxes.SIDES]
    new = [(F.col(s) - (F.when(F.col("roi_index") % 5 == 4, (F.col("x_max") - F.col("x_min")) / 4).otherwise(0) if s == "x_max" else 0)).alias(f"new_{s}") for s in boxes.SIDES]
    out = mutations.apply_revisions(p, p.select("roi_index", *old, *new))[0]
    return out.select("id", F.col("x_max").cast("double").alias("x_max"), F.col("embedding").isNotNull().alias("has_vector"))


# Ingest and tracks


@query(f"""SELECT CAST(row_number() OVER (ORDER BY video_path, frame_number) - 1 AS INT) AS id, label, CAST(x_min AS DOUBLE) AS x_min, verified FROM (SELECT video_path, frame_number, x_min, CASE class_id {' '.join(f"WHEN {i} THEN '{n}'" for i, n in CLASS_NAMES)} END AS label, 0 AS verified FROM observations WHERE CAST(confidence AS DOUBLE) >= 0.025)""")
def ingest_detections(spark, sf):
    rows = det.above(view(spark, sf, "observations"), "predict").withColumn("image_path", F.col("video_path"))
    empty = pred(spark, sf).limit(0)
    out = det.ingest(empty, rows, small(spark, CLASS_NAMES, "idx int, name string"), ["video_path", "frame_number"])
    return out.select("id", "label", F.col("x_min").cast("double").alias("x_min"), "verified")


@query("SELECT video_path, frame_number, class_id FROM observations WHERE frame_number % 30 = 0")
def stride_frames(spark, sf):
    return det.stride_rows(view(spark, sf, "observations")).select("video_path", "frame_number", "class_id")


@query("""SELECT video_path, track_id, class_id, track_length FROM (SELECT video_path, track_id, class_id, CAST(sum(count(*)) OVER (PARTITION BY video_path, track_id) AS BIGINT) AS track_length, row_number() OVER (PARTITION BY video_path, track_id ORDER BY count(*) DESC, min(frame_number), class_id) AS r FROM observations GROUP BY 1, 2, 3) WHERE r = 1""")
def track_majority(spark, sf):
    return det.track_majority(view(spark, sf, "observations"))


@query("""SELECT video_path, track_id, frame_number FROM (SELECT *, row_number() OVER (PARTITION BY video_path, track_id ORDER BY confidence DESC NULLS LAST, frame_number) AS r FROM (SELECT *, row_number() OVER (PARTITION BY video_path, track_id ORDER BY frame_number) - 1 AS i, count(*) OVER (PARTITION BY video_path, track_id) AS n FROM observations) WHERE n < 3 OR (i >= n // 3 AND i < 2 * n // 3)) WHERE r = 1""")
def track_representative(spark, sf):
    return det.representatives(view(spark, sf, "observations")).select("video_path", "track_id", "frame_number")


@query("SELECT video_path, track_id, median(CAST(x_min AS DOUBLE)) AS x_min, median(CAST(y_max AS DOUBLE)) AS y_max, count(*) AS n FROM observations GROUP BY 1, 2")
def track_median_box(spark, sf):
    o = view(spark, sf, "observations").withColumn("camera", F.col("video_path")).withColumn("track", F.col("track_id"))
    return linking.median_boxes(o).select(F.col("camera").alias("video_path"), F.col("track").alias("track_id"), "x_min", "y_max", "n")


# Files


@query("""SELECT image_path, CASE WHEN image_path LIKE '/survey/dive_0/%' THEN image_path WHEN image_path LIKE '/survey/dive_1/%' THEN replace(image_path, '/survey/', '/project/') WHEN image_path LIKE '/survey/dive_2/%' THEN '/project' || image_path ELSE image_path END AS found FROM (SELECT DISTINCT image_path FROM predictions)""")
def relocate_images(spark, sf):
    return files.relocated(pred(spark, sf), view(spark, sf, "inventory"), "/project")


@query("""SELECT image_path AS annotation_path, CASE WHEN n = 1 THEN image_path END AS image_path FROM (SELECT DISTINCT image_path, regexp_extract(image_path, '[^/]+$') AS name FROM predictions) JOIN (SELECT name, count(*) AS n FROM (SELECT DISTINCT image_path, regexp_extract(image_path, '[^/]+$') AS name FROM predictions) GROUP BY 1) USING (name)""")
def pair_annotations(spark, sf):
    images = pred(spark, sf).select("image_path").distinct()
    notes = images.select(F.col("image_path").alias("annotation_path"), F.concat(F.lit("flat/"), boxes.stem(boxes.path_name(F.col("image_path")))).alias("rel_stem"), boxes.path_name(F.col("image_path")).alias("filename"), F.lit(None).cast("string").alias("folder"))
    return files.paired(notes, images.select(F.col("image_path").alias("path")), "/survey").select("annotation_path", "image_path")


def _annotations(spark, sf):
    p = pred(spark, sf)
    return p.select("roi_index", F.concat("image_path", F.lit(".txt")).alias("annotation_path"), "image_path", "label", F.col("id").alias("line"), F.col("confidence").cast("double").alias("confidence"), *((F.col(s).cast("double") + F.when(F.col("roi_index") % 10 == 3, 3000).otherwise(0)).alias(s) for s in boxes.SIDES))


_REASON = "CASE WHEN s.width IS NULL THEN 'unreadable' WHEN p.roi_index % 10 = 3 THEN 'degenerate' ELSE 'imported' END"


@query(f"SELECT {_REASON} AS reason, count(*) AS n FROM predictions p LEFT JOIN image_sizes s USING (image_path) GROUP BY 1")
def import_counts(spark, sf):
    return files.import_counts(files.pixel_rows(_annotations(spark, sf), view(spark, sf, "image_sizes"), False))


_REPORT = """WITH @TABLES@, img AS (SELECT image_path, CAST(regexp_extract(image_path, '(\\d+)\\.png', 1) AS INT) AS k, count(*) FILTER (roi_index % 10 <> 7) AS n, count(*) FILTER (roi_index % 10 = 7) AS gone, count(*) FILTER (roi_index % 10 NOT IN (3, 7)) AS good, count(*) FILTER (roi_index % 10 = 3) AS bad FROM predictions GROUP BY 1),
f AS (SELECT img.*, CASE WHEN k % 13 = 5 THEN 'no_image' WHEN n = 0 THEN 'empty' WHEN k % 11 = 4 THEN 'already_present' WHEN s.width IS NULL THEN 'unreadable' ELSE 'taken' END AS fate FROM img LEFT JOIN image_sizes s USING (image_path))
SELECT c.counter, CAST(CASE c.counter WHEN 'images' THEN count(*) FILTER (fate = 'taken' AND good > 0) WHEN 'boxes' THEN sum(good) FILTER (fate = 'taken') WHEN 'degenerate' THEN sum(bad) FILTER (fate = 'taken') WHEN 'size_mismatch' THEN count(*) FILTER (fate = 'taken' AND k % 3 = 0)
 WHEN 'ambiguous' THEN count(*) FILTER (k % 26 = 5) WHEN 'skipped' THEN sum(gone) WHEN 'unlabelled' THEN (SELECT count(*) FROM image_sizes WHERE CAST(regexp_extract(image_path, '(\\d+)\\.png', 1) AS INT) % 13 = 5) ELSE count(*) FILTER (fate = c.counter) END AS BIGINT) AS n
FROM f, (SELECT unnest(['images', 'boxes', 'no_image', 'empty', 'already_present', 'unreadable', 'size_mismatch', 'degenerate', 'ambiguous', 'skipped', 'unlabelled']) AS counter) c GROUP BY 1"""


@query()
def import_report(spark, sf):
    """All that an import reports: annotation files of every image, some without one, in the table already, unreadable or of another size."""
    i, k = F.col("roi_index"), F.regexp_extract("image_path", r"(\d+)\.png", 1).cast("int")
    found = _annotations(spark, sf).withColumns({"skipped": i % 10 == 7, "declared_width": F.when(k % 3 == 0, 1919).otherwise(1920), "declared_height": F.lit(1080)})
    pairs = found.select("annotation_path", F.when(k % 13 != 5, F.col("image_path")).alias("image_path"), (k % 26 == 5).alias("ambiguous")).distinct()
    existing = found.filter(k % 11 == 4).select("image_path")
    sizes = view(spark, sf, "image_sizes")
    return files.import_report(found.drop("image_path"), pairs, sizes, existing, sizes.select(F.col("image_path").alias("path")), False)[1]


ORACLES["import_report"] = _REPORT.replace("WITH @TABLES@", oracle("predictions image_sizes").removesuffix("predictions image_sizes").rstrip())


@query(f"SELECT CAST(row_number() OVER (ORDER BY image_path || '.txt', p.id) - 1 AS INT) AS id, image_path, label, CAST(least(x_max, 1920) AS DOUBLE) AS x_max FROM predictions p LEFT JOIN image_sizes s USING (image_path) WHERE {_REASON} = 'imported'")
def import_annotations(spark, sf):
    rows = files.pixel_rows(_annotations(spark, sf), view(spark, sf, "image_sizes"), False).drop("roi_index")
    return det.import_rows(pred(spark, sf).limit(0), rows).select("id", "image_path", "label", F.col("x_max").cast("double").alias("x_max"))


@query("SELECT image_path FROM (SELECT DISTINCT image_path FROM predictions) JOIN image_sizes USING (image_path) WHERE CAST(regexp_extract(image_path, '(\\d+)\\.png', 1) AS INT) % 3 = 0")
def size_mismatch(spark, sf):
    n = F.regexp_extract("image_path", r"(\d+)\.png", 1).cast("int")
    notes = pred(spark, sf).select("image_path").distinct().select(F.col("image_path").alias("annotation_path"), "image_path", F.when(n % 3 == 0, 1919).otherwise(1920).alias("declared_width"), F.lit(1080).alias("declared_height"))
    return files.size_mismatches(notes, view(spark, sf, "image_sizes")).select("image_path")


def _folder(spark, content: DataFrame) -> str:
    """The files of (path, content) in a new folder that all tasks share."""
    root = scratch_path(spark, "files")
    root = root if "://" in root else "file://" + root.removeprefix("file:")
    naming.write_files(content, root)
    return root


_SEQ = "lpad(CAST(CAST(floor(id / 250.0) AS INT) AS VARCHAR), 6, '0')"


def _sequence():
    return F.lpad(F.floor(F.col("id") / 250).cast("int").cast("string"), 6, "0")


@query(f"SELECT 'a folder/säq_' || {_SEQ} AS rel_stem, CAST(row_number() OVER (PARTITION BY {_SEQ} ORDER BY id) - 1 AS INT) AS line, class_id, CASE class_id {' '.join(f"WHEN {i} THEN '{n}'" for i, n in CLASS_NAMES)} END AS label, CAST(id % 97 AS DOUBLE) / 100 AS cx FROM predictions")
def yolo_label_scan(spark, sf):
    p = pred(spark, sf)
    line = F.concat_ws(" ", F.col("class_id").cast("string"), (F.col("id") % 97 / 100).cast("string"), F.lit("0.5 0.1 0.1"))
    content = p.groupBy(F.concat(F.lit("a folder/säq_"), _sequence(), F.lit(".txt")).alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("x")))), lambda s: s["x"]), "\n").alias("content"))
    root = _folder(spark, content)
    naming.write_files(small(spark, [("names.txt", "\n".join(n for _, n in CLASS_NAMES))], "path string, content string"), root)
    names = files.names_file(spark, f"{root}/names.txt")
    return files.yolo_boxes(spark, root, names).select("rel_stem", "line", "class_id", "label", "cx")


@query(f"SELECT 'a folder/seq_' || {_SEQ} AS rel_stem, {EXPORT} AS label, CAST(trunc(x_min) AS DOUBLE) AS x_min, CAST(confidence AS DOUBLE) AS confidence FROM predictions WHERE {CURATED}")
def voc_scan(spark, sf):
    p = pred(spark, sf).filter(labels.curated()).withColumn("image_path", F.concat(F.lit("/survey/seq_"), _sequence(), F.lit(".png")))
    sizes = p.select("image_path").distinct().withColumn("width", F.lit(1920)).withColumn("height", F.lit(1080))
    root = _folder(spark, naming.voc_files(naming.voc_objects(p, sizes), naming.stem_map(p)).withColumn("path", F.concat(F.lit("a folder/"), "path")))
    return files.voc_boxes(spark, root).select("rel_stem", "label", "x_min", "confidence")


def _listing(spark, sf, suffix: str) -> str:
    p = pred(spark, sf).select(F.concat(F.lit("a/seq_"), _sequence()).alias("s")).distinct()
    return _folder(spark, p.select(F.explode(F.array(F.concat("s", F.lit(suffix)), F.concat("s", F.lit(".txt")))).alias("path"), F.lit("x").alias("content")))


@query(f"SELECT DISTINCT 'seq_' || {_SEQ} || '.JPG' AS name FROM predictions")
def image_inventory(spark, sf):
    return files.inventory(spark, _listing(spark, sf, ".JPG")).select(boxes.path_name(F.col("path")).alias("name"))


@query(f"SELECT DISTINCT 'seq_' || {_SEQ} || '.mp4' AS name FROM predictions")
def video_inventory(spark, sf):
    return files.inventory(spark, _listing(spark, sf, ".mp4"), files.VIDEOS).select(boxes.path_name(F.col("path")).alias("name"))


def _pictures(spark, sf):
    """A small PNG an image sequence, written by the tasks, and the boxes in it."""
    import struct
    import zlib

    rows = pred(spark, sf).select("id", "roi_index", _sequence().alias("seq"))

    def draw(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for seq in pdf["seq"]:
                px = ((np.add.outer(np.arange(48) * 7, np.arange(64) * 5) + int(seq)) % 251).astype(np.uint8)
                part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
                data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 64, 48, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in px))) + part(b"IEND", b"")
                out.append((f"{seq}.png", data))
            yield pd.DataFrame(out, columns=["path", "content"])

    root = _folder(spark, rows.select("seq").distinct().mapInPandas(draw, "path string, content binary"))
    i = F.col("id")
    found = rows.select("roi_index", F.concat(F.lit(root.removeprefix("file://") + "/"), "seq", F.lit(".png")).alias("image_path"), (i % 50).alias("x_min"), (i % 40).alias("y_min"), (i % 50 + 3 + i % 20).alias("x_max"), (i % 40 + 2 + i % 11).alias("y_max"))
    return root, found


@query()
def crops(spark, sf):
    from boxwright.operators import pixels

    root, rows = _pictures(spark, sf)
    return pixels.crops(pixels.images(spark, root), rows).select("roi_index", "width", "height", F.length("data").alias("n_bytes"))


@query()
def sharpness(spark, sf):
    from boxwright.operators import pixels

    root, rows = _pictures(spark, sf)
    return pixels.sharpness(pixels.crops(pixels.images(spark, root), rows))


def _scorer64(pdf):
    return [[float(i * (k + 1) % 7) for k in range(64)] for i in pdf["id"]]


@query()
def run_curation(spark, sf):
    """Ingest, vectors, clusters and exports of all embedded boxes through a store, in two runs."""
    from boxwright.plans import chain
    from boxwright.store import Store

    i = F.col("roi_index")
    rows = _embedded(spark, sf).withColumns({"id": i, "image_path": F.format_string("/survey/dive_%d/img_%06d.png", (i % 3), F.expr("roi_index div 8")), "embedding": F.when(i % 9 != 4, F.col("embedding")), "verified": F.when(i % 5 != 1, 1), "confidence": F.lit(0.5).cast("float")})
    corners = dict(zip(boxes.SIDES, (i % 50, i % 40, i % 50 + 20, i % 40 + 10), strict=True))
    rows = schema.ensure_columns(rows.drop("cluster").withColumns({s: c.cast("float") for s, c in corners.items()}))
    sizes = rows.select("image_path", F.lit(1920).alias("width"), F.lit(1080).alias("height")).distinct()
    store = Store(spark, scratch_path(spark, "chain"))
    chain.run(store, rows, _scorer64, [], sizes, last="embed")
    out = chain.run(store, None, _scorer64, [], sizes, first="cluster", last="export")
    table = store.full("predictions").agg(F.count("*").alias("n"), F.count("embedding").alias("n_vectors"), F.count("evoc_clust").alias("n_clustered"), F.count_if(F.col("new_label").isNotNull()).alias("n_named"))
    shown = out["html"].select(F.explode(F.regexp_extract_all("content", F.lit("<h2>([^<]*)</h2>"))).alias("image"))
    noise = store.read("predictions").filter("verified = 1").groupBy("image_path").agg(F.count_if(F.col("new_label") != "noise").alias("n"))
    return table.withColumns({"n_pages": out["html"].agg(F.count("*").alias("n")).scalar(), "n_shown": shown.agg(F.count("*").alias("n")).scalar(), "missed": noise.agg(F.count_if(F.col("n") > 0).alias("n")).scalar() - out["voc"].agg(F.count("*").alias("n")).scalar()})


#: Clusters differ with the method, so what the annotations leave out as noise is held against the stored names.
ORACLES["run_curation"] = "SELECT count(*) AS n, count(*) AS n_vectors, count(*) AS n_clustered, count(*) AS n_named, CAST((count(DISTINCT (vec_id % 3, vec_id // 8)) FILTER (vec_id % 5 <> 1) + 249) // 250 AS BIGINT) AS n_pages, count(DISTINCT (vec_id % 3, vec_id // 8)) FILTER (vec_id % 5 <> 1) AS n_shown, CAST(0 AS BIGINT) AS missed FROM embeddings"



_MAJORITY = f"""SELECT fixture, lab AS label, k, n, n_unverified, k_unverified FROM (SELECT fixture, coalesce({REVIEW}, '') AS lab, count(*) AS k, count(*) FILTER (WHERE {OPEN}) AS k_unverified, CAST(sum(count(*)) OVER (PARTITION BY fixture) AS BIGINT) AS n, CAST(sum(count(*) FILTER (WHERE {OPEN})) OVER (PARTITION BY fixture) AS BIGINT) AS n_unverified,
 row_number() OVER (PARTITION BY fixture ORDER BY count(*) DESC, coalesce({REVIEW}, '')) AS r FROM fixtures_given JOIN predictions USING (roi_index) GROUP BY 1, 2) WHERE r = 1"""


# Vectors

_POOL = "pool AS (SELECT roi_index, coalesce(nullif(new_label, ''), label, '') AS label, embedding FROM predictions WHERE embedding IS NOT NULL), mean AS (SELECT list(a ORDER BY k) AS m FROM (SELECT k, avg(CAST(embedding[k] AS DOUBLE)) AS a FROM pool, range(1, 65) t(k) GROUP BY k)), centred AS (SELECT roi_index, label, [CAST(embedding[k] AS DOUBLE) - m[k] for k in range(1, 65)] AS v FROM pool, mean)"


def _with(view_name: str, body: str, *ctes: str) -> str:
    """SQL over one derived table and further common table expressions."""
    return oracle(view_name).removesuffix(view_name).rstrip() + ",\n" + ",\n".join(ctes) + "\n" + body


@query()
def similar_rois(spark, sf):
    return vectors.similar(pred(spark, sf), 10).select("roi_index", F.round("score", 4).alias("score"))


ORACLES["similar_rois"] = _with("predictions", "SELECT c.roi_index, round(list_cosine_similarity(c.v, r.v), 4) AS score FROM centred c, (SELECT v FROM centred WHERE roi_index = 10) r", _POOL)


@query()
def outliers_in_label(spark, sf):
    return vectors.outliers(pred(spark, sf)).select("roi_index", "label", (F.round("score", 4) + 0.0).alias("score"))


ORACLES["outliers_in_label"] = _with(
    "predictions",
    "SELECT p.roi_index, p.label, round(list_cosine_similarity(u.u, c.c), 4) + 0.0 AS score FROM (SELECT roi_index, coalesce(nullif(new_label, ''), label, '') AS label FROM predictions) p LEFT JOIN unit u USING (roi_index) LEFT JOIN centroid c ON c.label = p.label",
    _POOL,
    "unit AS (SELECT roi_index, label, [x / sqrt(list_inner_product(v, v)) for x in v] AS u FROM centred)",
    "centroid AS (SELECT label, list(a ORDER BY k) AS c FROM (SELECT label, k, avg(u[k]) AS a FROM unit, range(1, 65) t(k) GROUP BY label, k) GROUP BY label)",
)


_EXPORTED = f"SELECT image_path, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN parent || '_' || stem ELSE stem END AS dest FROM (SELECT DISTINCT image_path, regexp_extract(image_path, '([^/]+)\\.[^./]+$', 1) AS stem, regexp_extract(image_path, '([^/]+)/[^/]+$', 1) AS parent FROM predictions WHERE {CURATED})"
ORACLES["image_label_lines"] = _with("predictions", _LINES.format(corner="image"), f"cells AS (SELECT dest AS r, label AS c, n FROM ({_IMAGE_LABELS}) JOIN ({_EXPORTED}) USING (image_path))")
ORACLES["taxa_lines"] = _with("predictions", _LINES.format(corner="taxa"), "cells AS (SELECT label AS r, image_name AS c, count(*) AS n FROM predictions GROUP BY 1, 2)")


def _three_pages(stored: ranking.Ranking, size: int) -> DataFrame:
    """The first, a middle and the last page."""
    return stored.page(0, size).union(stored.page(stored.size // 2, size)).union(stored.last(size))


_PAGES = "WHERE rank <= {n} OR (rank > (SELECT count(*) FROM ranked) // 2 AND rank <= (SELECT count(*) FROM ranked) // 2 + {n}) OR rank > ((SELECT count(*) FROM ranked) - 1) // {n} * {n}"


@query()
def similar_pages(spark, sf):
    stored = ranking.Ranking(vectors.similar_scores(pred(spark, sf), 10), F.round("score", 9).desc(), "roi_index")
    return _three_pages(stored, 100).select("roi_index", "rank")


ORACLES["similar_pages"] = _with("predictions", f"SELECT roi_index, rank FROM ranked {_PAGES.format(n=100)}", _POOL, "ranked AS (SELECT c.roi_index, row_number() OVER (ORDER BY round(list_cosine_similarity(c.v, r.v), 9) DESC, c.roi_index) AS rank FROM centred c, (SELECT v FROM centred WHERE roi_index = 10) r)")


@query()
def outlier_pages(spark, sf):
    stored = ranking.Ranking(vectors.outlier_scores(pred(spark, sf)), F.lower("label"), F.round("score", 9).asc_nulls_last(), "roi_index")
    return _three_pages(stored, 100).select("roi_index", "label", "rank")


ORACLES["outlier_pages"] = _with(
    "predictions",
    f"SELECT roi_index, label, rank FROM ranked {_PAGES.format(n=100)}",
    _POOL,
    "unit AS (SELECT roi_index, label, [x / sqrt(list_inner_product(v, v)) for x in v] AS u FROM centred)",
    "centroid AS (SELECT label, list(a ORDER BY k) AS c FROM (SELECT label, k, avg(u[k]) AS a FROM unit, range(1, 65) t(k) GROUP BY label, k) GROUP BY label)",
    "ranked AS (SELECT p.roi_index, p.label, row_number() OVER (ORDER BY lower(p.label), round(list_cosine_similarity(u.u, c.c), 9) NULLS LAST, p.roi_index) AS rank FROM (SELECT roi_index, coalesce(nullif(new_label, ''), label, '') AS label FROM predictions) p LEFT JOIN unit u USING (roi_index) LEFT JOIN centroid c ON c.label = p.label)",
)


@query(f"SELECT fixture, label, rank FROM (SELECT fixture, label, row_number() OVER (ORDER BY n - k, n DESC, fixture) AS rank FROM ({_MAJORITY})) WHERE rank > 10 AND rank <= 25")
def animal_pages(spark, sf):
    majority = review.animal_majority(pred(spark, sf), view(spark, sf, "fixtures_given"))
    stored = ranking.Ranking(majority, F.col("n") - F.col("k"), F.desc("n"), "fixture")
    return stored.page(10, 15).select("fixture", "label", "rank")


@query()
def pool_mean(spark, sf):
    return vectors.mean_vector(pred(spark, sf), "embedding").select("n", F.posexplode("mean").alias("k", "x")).select("n", "k", F.round("x", 6).alias("x"))


ORACLES["pool_mean"] = _with("predictions", "SELECT (SELECT count(*) FROM pool) AS n, CAST(k - 1 AS INT) AS k, round(m[k], 6) AS x FROM mean, range(1, 65) t(k)", _POOL)


def _scorer(pdf):
    return [[float(i % 7), float(i % 3)] for i in pdf["id"]]


@query("SELECT id, CASE WHEN embedding IS NULL THEN CAST(id % 7 AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) END AS first FROM predictions")
def fill_embeddings(spark, sf):
    return vectors.fill(pred(spark, sf), _scorer, [])[0].select("id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


# Animals


@query("SELECT image_path, video_path, frame_number, CAST(dense_rank() OVER (ORDER BY video_path NULLS FIRST, frame_number NULLS FIRST, image_path) AS INT) AS frame FROM (SELECT DISTINCT image_path, video_path, frame_number FROM predictions)")
def frame_rank(spark, sf):
    return linking.frame_ranks(pred(spark, sf)).select("image_path", "video_path", "frame_number", "frame")


def _linked(spark, sf):
    rows = view(spark, sf, "linked_boxes")
    return rows, linking.link(rows).withColumn("track", F.col("track").cast("string"))


_SLOTS = "SELECT camera, slot, count(*) AS n, min(frame) AS first, max(frame) AS last FROM linked_boxes WHERE slot < 9 GROUP BY 1, 2 HAVING count(*) >= 20"


@query(f"SELECT n, first, last FROM ({_SLOTS})")
def fixture_link(spark, sf):
    rows, tracks = _linked(spark, sf)
    return linking.kept(rows.join(tracks, ["camera", "roi_index"])).groupBy("fixture").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last")).select("n", "first", "last")


@query(f"SELECT n, first, last FROM ({_SLOTS})")
def fixture_link_one_camera(spark, sf):
    """Both cameras' boxes side by side in the pictures of one, linked in as many tasks as they have zones."""
    rows = view(spark, sf, "linked_boxes").withColumn("aside", F.when(F.col("camera") == "cam_1", 4000).otherwise(0))
    rows = rows.withColumns({"x_min": (F.col("x_min") + F.col("aside")).cast("float"), "x_max": (F.col("x_max") + F.col("aside")).cast("float"), "camera": F.lit("one")})
    found = linking.kept(rows.join(linking.link(rows), ["camera", "roi_index"]))
    return found.groupBy("fixture").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last")).select("n", "first", "last")


@query("SELECT CAST(slot AS INT) AS slot, camera, count(*) AS n, arg_max(roi_index, CAST(confidence AS DOUBLE) * 1e9 - roi_index) AS rep_roi_index, min(frame) AS first, max(frame) AS last FROM linked_boxes WHERE slot < 9 GROUP BY 1, 2 HAVING count(*) >= 20")
def fixture_info(spark, sf):
    rows, tracks = _linked(spark, sf)
    found = linking.kept(rows.join(tracks, ["camera", "roi_index"])).withColumn("typicality", F.lit(None).cast("double")).withColumn("image_path", F.col("frame"))
    about = found.groupBy("fixture").agg(F.min("slot").alias("slot"), F.min("camera").alias("camera"))
    return linking.fixture_info(found).join(about, "fixture").select("slot", "camera", "n", "rep_roi_index", F.col("first_image").alias("first"), F.col("last_image").alias("last"))


def _given_vectors(spark, sf):
    rows = view(spark, sf, "linked_boxes").filter("slot < 9").withColumn("track", F.col("slot").cast("string"))
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = rows.join(emb, "vec_id")
    return rows, linking.unit_vectors(rows)


@query()
def fixture_typicality(spark, sf):
    rows, units = _given_vectors(spark, sf)
    return linking.typicality(rows.select("camera", "roi_index", "track"), units).select("roi_index", F.round("typicality", 4).alias("typicality"))


_LINKED_UNITS = (
    "rows_ AS (SELECT l.camera, l.slot, l.roi_index, e.embedding FROM linked_boxes l JOIN embeddings e USING (vec_id) WHERE l.slot < 9)",
    "mean AS (SELECT list(a ORDER BY k) AS m FROM (SELECT k, avg(CAST(embedding[k] AS DOUBLE)) AS a FROM rows_, range(1, 65) t(k) GROUP BY k))",
    "centred AS (SELECT camera, slot, roi_index, [CAST(embedding[k] AS DOUBLE) - m[k] for k in range(1, 65)] AS v FROM rows_, mean)",
    "unit AS (SELECT camera, slot, roi_index, [x / sqrt(list_inner_product(v, v)) for x in v] AS u FROM centred)",
    "centroid AS (SELECT camera, slot, list(a ORDER BY k) AS c FROM (SELECT camera, slot, k, avg(u[k]) AS a FROM unit, range(1, 65) t(k) GROUP BY camera, slot, k) GROUP BY camera, slot)",
)
ORACLES["fixture_typicality"] = _with("linked_boxes", "SELECT roi_index, round(list_cosine_similarity(u, c), 4) AS typicality FROM unit JOIN centroid USING (camera, slot)", *_LINKED_UNITS)


ORACLES["fixture_split"] = _with(
    "linked_boxes",
    """SELECT l.camera, l.roi_index, CASE WHEN l.label = m.label OR list_cosine_similarity(a.c, b.c) >= 0.9 THEN CAST(l.slot AS VARCHAR) WHEN g.n >= 20 THEN CAST(l.slot AS VARCHAR) || '/' || l.label END AS track
 FROM lab l JOIN main_label m USING (camera, slot) JOIN groups g ON g.camera = l.camera AND g.slot = l.slot AND g.label = l.label JOIN look a ON a.camera = l.camera AND a.slot = l.slot AND a.label = l.label JOIN look b ON b.camera = l.camera AND b.slot = l.slot AND b.label = m.label""",
    *_LINKED_UNITS,
    "lab AS (SELECT camera, slot, roi_index, label FROM linked_boxes WHERE slot < 9)",
    "groups AS (SELECT camera, slot, label, count(*) AS n FROM lab GROUP BY 1, 2, 3)",
    "main_label AS (SELECT camera, slot, label FROM groups QUALIFY row_number() OVER (PARTITION BY camera, slot ORDER BY n DESC, label) = 1)",
    "look AS (SELECT camera, slot, label, list(a ORDER BY k) AS c FROM (SELECT u.camera, u.slot, l.label, k, avg(u.u[k]) AS a FROM unit u JOIN lab l USING (roi_index), range(1, 65) t(k) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)",
)


@query()
def fixture_split(spark, sf):
    rows, units = _given_vectors(spark, sf)
    return linking.split_labels(rows.select("camera", "roi_index", "track"), rows.select("roi_index", F.col("label").alias("lab")), units)


@query()
def fixture_merge(spark, sf):
    rows, units = _given_vectors(spark, sf)
    pieces = rows.withColumn("track", F.concat_ws("/", "track", F.floor(F.col("frame") / 100).cast("string")))
    into = linking.merge_fragments(pieces, units)
    placed = pieces.select("camera", "slot", "track").distinct().join(into, ["camera", "track"], "left")
    return placed.groupBy("camera", "slot").agg(F.count("*").alias("pieces"), F.count_distinct(F.coalesce("into", "track")).alias("fixtures"))


# Pieces of one slot stand in one spot in different frames and look alike; no two slots share a spot.
ORACLES["fixture_merge"] = oracle("SELECT camera, CAST(slot AS INT) AS slot, count(DISTINCT floor(frame / 100.0)) AS pieces, CAST(1 AS BIGINT) AS fixtures FROM linked_boxes WHERE slot < 9 GROUP BY 1, 2")


def _survey(spark, sf):
    """The linked boxes as a detection table of their own, frames without a video among them."""
    rows = view(spark, sf, "linked_boxes").join(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding"), "vec_id")
    video = F.when(F.col("camera") == "cam_0", F.lit("/survey/cam_0.mp4"))
    image = F.concat_ws("/", F.lit("/survey"), "camera", F.lpad(F.col("frame").cast("string"), 7, "0"))
    return rows.withColumns({"image_path": image, "video_path": video, "frame_number": F.when(video.isNotNull(), F.col("frame")), "new_label": F.lit(None).cast("string")})


#: The slots that are kept as individuals: every box but those of frames in which something else stands there; the fixtures' numbers follow camera and first box.
_KEPT_SLOTS = "good AS (SELECT camera, slot, roi_index, frame, CAST(confidence AS DOUBLE) AS confidence FROM linked_boxes WHERE slot < 9 AND frame % 41 <> 5), sized AS (SELECT camera, slot, count(*) AS n, min(roi_index) AS first FROM good GROUP BY 1, 2 HAVING count(*) >= 20)"


@query()
def fixtures_run(spark, sf):
    found = linking.fixtures(_survey(spark, sf), "camera")
    return found["fixture_info"].select("fixture", "n", "first_image", "last_image")


ORACLES["fixtures_run"] = _with("linked_boxes", """SELECT CAST(row_number() OVER (ORDER BY camera, first) - 1 AS INT) AS fixture, n, '/survey/' || camera || '/' || lpad(CAST(low AS VARCHAR), 7, '0') AS first_image, '/survey/' || camera || '/' || lpad(CAST(high AS VARCHAR), 7, '0') AS last_image
 FROM sized JOIN (SELECT camera, slot, min(frame) AS low, max(frame) AS high FROM good GROUP BY 1, 2) USING (camera, slot)""", _KEPT_SLOTS)


@query()
def fixture_coverage(spark, sf):
    return linking.fixtures(_survey(spark, sf), "camera")["coverage"].select("fixtures", "kept", "boxes", "percent")


ORACLES["fixture_coverage"] = _with("linked_boxes", "SELECT (SELECT count(*) FROM sized) AS fixtures, CAST((SELECT sum(n) FROM sized) AS BIGINT) AS kept, (SELECT count(*) FROM linked_boxes) AS boxes, round(100.0 * (SELECT sum(n) FROM sized) / (SELECT count(*) FROM linked_boxes), 1) AS percent", _KEPT_SLOTS)


@query(f"SELECT * FROM ({_MAJORITY}) WHERE k_unverified > 0")
def animal_order(spark, sf):
    return review.animal_order(review.animal_majority(pred(spark, sf), view(spark, sf, "fixtures_given")), hide_verified=True)


@query(f"SELECT roi_index, typicality FROM fixtures_given JOIN predictions USING (roi_index) WHERE fixture = 7 AND {OPEN}")
def animal_members(spark, sf):
    return review.animal_members(pred(spark, sf), view(spark, sf, "fixtures_given"), 7, hide_verified=True).select("roi_index", "typicality")


# Clusters


def _embedded(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("int").alias("roi_index"), "embedding", F.concat(F.lit("kind_"), (F.col("label") % 6).cast("string")).alias("label"), F.lit(None).cast("string").alias("new_label"), F.col("label").cast("int").alias("cluster"))


@query("""SELECT cluster, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || '_' || CAST(row_number() OVER (PARTITION BY label ORDER BY cluster) AS VARCHAR) ELSE label END AS name FROM (SELECT DISTINCT CAST(label AS INT) AS cluster, 'kind_' || CAST(label % 6 AS VARCHAR) AS label FROM embeddings)""")
def cluster_names(spark, sf):
    return clustering.cluster_names(clustering.dominant_labels(_embedded(spark, sf)))


@query("""WITH g AS (SELECT CAST(label AS VARCHAR) AS "group", CAST(vec_id AS INT) AS roi_index, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
 s AS (SELECT *, ceil(sqrt(n)) AS r FROM g), c AS (SELECT *, ceil(n / r) AS c FROM s), t AS (SELECT *, CAST(floor(least((2550 - 5 * (c - 1)) / c, (3300 - 5 * (r - 1)) / r)) AS INT) AS tile FROM c),
 a AS (SELECT *, CAST(floor(2555 / (tile + 5)) AS INT) AS across, CAST(floor(3305 / (tile + 5)) AS INT) AS down FROM t)
 SELECT "group", roi_index, CAST(1 + i // (across * down) AS INT) AS page, CAST((i % (across * down)) % across * (tile + 5) AS INT) AS x, CAST((i % (across * down)) // across * (tile + 5) AS INT) AS y, tile FROM a""")
def contact_sheet(spark, sf):
    return clustering.contact_sheet(_embedded(spark, sf).select(F.col("cluster").cast("string").alias("group"), "roi_index"))


@query()
def cluster_embeddings(spark, sf):
    rows = _embedded(spark, sf)
    return clustering.named_clusters(rows, clustering.clusters(rows))


@query()
def refine_label(spark, sf):
    rows = _embedded(spark, sf).withColumn("new_label", F.lit("crab"))
    return clustering.refine(rows, "crab")


# SQL and streams


@query(f"SELECT {REVIEW} AS label, count(*) AS n FROM predictions GROUP BY 1")
def adhoc_sql(spark, sf):
    return review.adhoc(spark, f"SELECT {REVIEW} AS label, count(*) AS n FROM predictions GROUP BY 1", predictions=pred(spark, sf))[0]


@query("SELECT image_path, count(*) AS n FROM predictions GROUP BY 1")
def incremental_ingest(spark, sf):
    """Two sources, each with its own checkpoint, into one table; the labels change in between, and both are run again."""
    from boxwright.store import Store
    from boxwright.streaming.ingest import incremental

    p = pred(spark, sf).select("id", "roi_index", "image_path", "label", F.lit(None).cast("string").alias("new_label"))
    root = scratch_path(spark, "stream")
    store = Store(spark, f"{root}/store")
    store.write(predictions=p.limit(0))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema)
    for k in (0, 1):
        p.filter(F.col("id") % 3 == k if k else F.col("id") % 3 != 1).repartition(2, "image_path").write.parquet(f"{root}/in{k}")
    for k in (0, 1, 0, 1):
        incremental(spark, f"{root}/in{k}", ddl, store, f"{root}/checkpoint{k}", ["image_path", "roi_index"])
        store.change("predictions", store.read("predictions").select("id", F.lit("seen").alias("new_label")))
    return store.read("predictions").filter("new_label = 'seen'").groupBy("image_path").agg(F.count("*").alias("n"))


def _stored(spark, sf):
    from boxwright.store import Store

    store = Store(spark, scratch_path(spark, "store"))
    store.write(predictions=pred(spark, sf))
    return store


@query(f"""SELECT id, CASE WHEN id % 10 = 3 THEN 'crab' WHEN id % 10 = 4 THEN NULL ELSE new_label END AS new_label, CASE WHEN id % 10 = 3 THEN 1 WHEN id % 15 = 0 THEN 0 ELSE verified END AS verified, CASE WHEN id % 6 = 1 THEN 2 ELSE len(embedding) END AS dims FROM predictions WHERE id % 20 <> 7
 UNION ALL SELECT CAST((SELECT max(id) FROM predictions WHERE id % 20 <> 7) + row_number() OVER (ORDER BY roi_index) AS INT), 'drawn', 1, NULL FROM (SELECT DISTINCT roi_index FROM box_list)""")
def store_changes(spark, sf):
    """Labels, marks, vectors, deletions and further rows as changes to a stored table, then read."""
    store, i = _stored(spark, sf), F.col("id")
    ids = store.read("predictions").select("id", "roi_index")
    store.change("predictions", ids.filter(i % 15 == 0).select("id", F.lit(0).alias("verified")))
    store.change("predictions", mutations.label_changes(ids.filter(i % 10 == 3), "first").join(ids, "roi_index").drop("roi_index"))
    store.change("predictions", ids.filter((i % 10).isin(3, 4)).select("id", F.when(i % 10 == 3, "crab").alias("new_label")))
    store.change("predictions", ids.filter(i % 6 == 1).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")))
    store.delete("predictions", ids.filter(i % 20 == 7))
    drawn = view(spark, sf, "box_list").select("roi_index").distinct().withColumns({"new_label": F.lit("drawn"), "verified": F.lit(1)})
    store.append("predictions", lambda now: mutations.next_rows(now, drawn, ["roi_index"]))
    return store.full("predictions").select("id", "new_label", "verified", F.size("embedding").cast("bigint").alias("dims"))


@query("SELECT id, label, CAST(x_min AS DOUBLE) AS x_min, len(embedding) AS dims FROM predictions")
def store_full(spark, sf):
    return _stored(spark, sf).full("predictions").select("id", "label", F.col("x_min").cast("double").alias("x_min"), F.size("embedding").cast("bigint").alias("dims"))


@query("SELECT id, 'image' AS of FROM predictions WHERE image_path = '/survey/dive_2/img_000022.png' UNION ALL SELECT id, 'list' FROM predictions WHERE roi_index IN (SELECT roi_index FROM box_list)")
def store_point_reads(spark, sf):
    table = _stored(spark, sf).read("predictions")
    image = review.rois_for_image(table, "/survey/dive_2/img_000022.png").select("id", F.lit("image").alias("of"))
    return image.union(review.listed(table, view(spark, sf, "box_list")).select("id", F.lit("list").alias("of")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if v}
