"""Inventories, lists and annotation files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions import boxes
from boxwright.session import cut

IMAGES = ("jpg", "jpeg", "png", "tif", "tiff")
VIDEOS = ("mp4", "mov", "avi", "mkv", "m4v", "mpg", "mpeg", "wmv")


def inventory(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGES, limit: int | None = None, sample: bool = False, seed: int = 0) -> DataFrame:
    """Paths under a folder (or one file), sorted; ``limit`` takes the first, or a seeded sample of so many."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    found = found.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    if not found.limit(1).count():
        raise FileNotFoundError(f"nothing with {', '.join(extensions)} under {root}")
    if limit is not None:
        found = found.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(limit) if sample else found.orderBy("path").limit(limit)
    return found.orderBy("path")


def local_path(path: Column) -> Column:
    """A path as it is on disk, from what Spark says of a file: without scheme, its %-codes decoded ('+' is itself)."""
    return F.url_decode(F.replace(F.regexp_replace(path, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))


def _below(path: Column, root: str, suffix: str) -> Column:
    """A path relative to a folder, without its suffix."""
    base = "/" + root.removeprefix("file:").strip("/")
    return F.regexp_replace(F.substr(path, F.lit(len(base) + 2)), rf"(?i)\.{suffix}$", "")


#: Where Python's ``splitlines`` ends a line, as far as text files go.
NEW_LINE = "\r\n|[\n\r\x0b\x0c]"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", NEW_LINE)).alias("line", "text"))


def names_file(spark: SparkSession, path: str) -> DataFrame:
    """idx, name from lines, or from the ``names`` list or map of a dataset YAML; duplicates, or none, are an error."""
    text = spark.read.text(path, wholetext=True).first()
    text = text["value"] if text else ""
    if path.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"PyYAML is needed to read {path}") from e
        names = (yaml.safe_load(text) or {}).get("names")
        names = [names[i] for i in sorted(names)] if isinstance(names, dict) else names
        if not isinstance(names, list):
            raise ValueError(f"{path} has no list or map of names")
        names = [str(x).strip() for x in names]
    else:
        names = [x.strip() for x in text.splitlines() if x.strip()]
    if twice := sorted({x for x in names if names.count(x) > 1}):
        raise ValueError(f"names are not unique in {path}: {', '.join(twice)}")
    if not names:
        raise ValueError(f"{path} has no names")
    return spark.createDataFrame(list(enumerate(names)), "idx int, name string")


#: Text files beside labels that are none.
NO_LABELS = ("names.txt", "classes.txt", "notes.txt")


def yolo_boxes(spark: SparkSession, root: str, names: DataFrame, limit: int | None = None) -> DataFrame:
    """annotation_path, rel_stem, line, class_id, label, cx, cy, w, h, confidence of label files.

    Any line that can't be read, or a class without a name, is an error before
    anything else is made. Files without a box, of zero bytes too, have one row without one.
    """
    from boxwright.sources.folder import listing

    found = listing(spark, root).filter(F.lower("path").endswith(".txt") & ~F.lower(boxes.path_name(F.col("path"))).isin(*NO_LABELS)).select(F.col("path").alias("annotation_path"), "size")
    if limit is not None:
        found = found.orderBy("annotation_path").limit(limit)
    if found.isEmpty():
        raise FileNotFoundError(f"no label files under {root}")
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").text(root, wholetext=True).select(local_path(F.col("_metadata.file_path")).alias("annotation_path"), "value")
    rows = found.join(texts, "annotation_path", "left").select("annotation_path", F.coalesce("value", F.lit("")).alias("value"))
    blank = r"^\s+|\s+$"
    lines = rows.select("annotation_path", F.posexplode_outer(F.filter(F.transform(F.split("value", NEW_LINE), lambda x: F.regexp_replace(x, blank, "")), lambda x: x != "")).alias("line", "text"))
    v = F.transform(F.expr(r"slice(split(text, '\\s+'), 2, greatest(size(split(text, '\\s+')) - 1, 0))"), lambda x: x.try_cast("double"))
    parts = lines.select("annotation_path", "line", "text", F.get(F.split("text", r"\s+"), F.lit(0)).try_cast("double").try_cast("int").alias("class_id"), v.alias("v"))
    n = F.size("v")
    polygon = (n >= 6) & (n % 2 == 0)
    xs, ys = F.filter("v", lambda x, i: i % 2 == 0), F.filter("v", lambda x, i: i % 2 == 1)
    span = lambda a: (F.array_min(a), F.array_max(a))
    (x0, x1), (y0, y1) = span(xs), span(ys)
    g = lambda i: F.get("v", F.lit(i))
    pick = lambda plain, poly: F.when(polygon, poly).otherwise(plain)
    out = parts.join(F.broadcast(names.select(F.col("idx").alias("class_id"), F.col("name").alias("label"))), "class_id", "left")
    bad = F.col("text").isNotNull() & (F.col("class_id").isNull() | F.col("label").isNull() | F.exists("v", lambda x: x.isNull()) | ~((n == 4) | (n == 5) | polygon))
    wrong = out.filter(F.coalesce(bad, F.lit(True)) & F.col("text").isNotNull()).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['annotation_path']}: can't read {wrong[0]['text']!r}")
    stem = _below(F.col("annotation_path"), root, "txt")
    return out.select("annotation_path", stem.alias("rel_stem"), "line", "class_id", "label", pick(g(0), (x0 + x1) / 2).alias("cx"), pick(g(1), (y0 + y1) / 2).alias("cy"), pick(g(2), x1 - x0).alias("w"), pick(g(3), y1 - y0).alias("h"), F.when(n == 5, g(4)).alias("confidence"))


VOC = "folder string, filename string, size struct<width:string,height:string>, object array<struct<name:string,confidence:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"


def voc_boxes(spark: SparkSession, root: str) -> DataFrame:
    """annotation_path, rel_stem, filename, folder, declared size and boxes; ``skipped`` marks objects without a name or a full box."""
    where = local_path(F.col("_metadata.file_path"))
    rows = spark.read.format("xml").option("rowTag", "annotation").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").schema(VOC).load(root).select("*", where.alias("annotation_path"))
    flat = rows.select("annotation_path", "folder", "filename", F.col("size.width").try_cast("int").alias("declared_width"), F.col("size.height").try_cast("int").alias("declared_height"), F.posexplode_outer("object").alias("line", "o"))
    num = lambda c: F.col(f"o.bndbox.{c}").try_cast("double")
    missing = F.col("o.name").isNull() | num("xmin").isNull() | num("ymin").isNull() | num("xmax").isNull() | num("ymax").isNull()
    stem = _below(F.col("annotation_path"), root, "xml")
    return flat.select("annotation_path", stem.alias("rel_stem"), "filename", "folder", "declared_width", "declared_height", "line", F.col("o.name").alias("label"), num("xmin").alias("x_min"), num("ymin").alias("y_min"), num("xmax").alias("x_max"), num("ymax").alias("y_max"), F.col("o.confidence").try_cast("double").alias("confidence"), (F.col("line").isNotNull() & missing).alias("skipped"))


def remap_csv(spark: SparkSession, path: str) -> DataFrame:
    """old_label, new_label, line of a headerless two-column CSV; a row of another number of fields is an error, an empty field is none.

    The reader is Python's, quoted line breaks included, for a file of rules that a person wrote.
    """
    import csv
    import io

    text = spark.read.text(path, wholetext=True).first()
    rows = []
    for i, row in enumerate(csv.reader(io.StringIO((text["value"] if text else "").removeprefix("\ufeff"), newline=""))):
        if row and len(row) != 2:
            raise ValueError(f"{path}, row {i + 1}: two columns are needed, not {row!r}")
        if row:
            rows.append((row[0].strip(), row[1].strip(), i))
    return spark.createDataFrame(rows, "old_label string, new_label string, line int")


def box_list_csv(spark: SparkSession, path: str) -> DataFrame:
    """pos, roi_index, note of a CSV with a roi_index or id column; blank ids are skipped, the first place counts."""
    head = spark.read.option("header", True).csv(path)
    by = {c.lower().strip(): c for c in head.columns}
    key = by.get("roi_index", by.get("id"))
    if key is None:
        raise ValueError(f"{path} has neither a roi_index nor an id column")
    note = by.get("suggested", by.get("note"))
    rows = head.select(F.monotonically_increasing_id().alias("pos"), F.trim(F.col(key)).try_cast("double").cast("int").alias("roi_index"), (F.col(note) if note else F.lit(None).cast("string")).alias("note"))
    rows = rows.filter("roi_index is not null")
    return rows.groupBy("roi_index").agg(F.min("pos").alias("pos"), F.min_by("note", "pos").alias("note"))


def pinned_list(spark: SparkSession, path: str) -> DataFrame:
    """name: lines that are neither blank nor begin with #."""
    name = F.regexp_replace("text", r"^\s+|\s+$", "")
    return _lines(spark, path).select(name.alias("name")).filter((F.col("name") != "") & ~F.col("name").startswith("#"))


def paired(annotations: DataFrame, images: DataFrame, root: str) -> DataFrame:
    """annotation_path, image_path (null if none), ambiguous.

    ``annotations``: annotation_path, rel_stem, filename, folder (null for YOLO).
    In order: the named file in the same relative folder; the same relative
    stem; the only image of that file name (of those in the named folder if
    there are several); the only one of that stem.
    """
    base = "/" + root.strip("/")
    img = images.select(F.col("path").alias("image"), F.substr("path", F.lit(len(base) + 2)).alias("rel"))
    img = img.withColumn("name", boxes.path_name(F.col("rel"))).withColumn("stem", boxes.stem(F.col("name"))).withColumn("rel_key", boxes.stem(F.col("rel"))).withColumn("in_folder", boxes.path_parent(F.col("image")))
    a = annotations.select("annotation_path", "rel_stem", "filename", "folder").distinct()
    up = F.regexp_replace("rel_stem", r"[^/]*$", "")
    same_dir = a.filter("filename is not null").withColumn("k", F.concat(up, boxes.stem(F.col("filename")))).join(img, F.col("k") == F.col("rel_key")).filter("name = filename").groupBy("annotation_path").agg(F.max("image").alias("p1"))
    same_stem = a.join(img, F.col("rel_stem") == F.col("rel_key")).groupBy("annotation_path").agg(F.max("image").alias("p2"))
    by_name = a.filter("filename is not null").join(img, F.col("filename") == F.col("name"))
    by_name = by_name.groupBy("annotation_path").agg(F.count("*").alias("n"), F.max("image").alias("one"), F.count_if(F.col("in_folder") == F.col("folder")).alias("nf"), F.max(F.when(F.col("in_folder") == F.col("folder"), F.col("image"))).alias("onef"))
    by_name = by_name.select("annotation_path", F.when(F.col("n") == 1, F.col("one")).when(F.col("nf") == 1, F.col("onef")).alias("p3"), F.lit(True).alias("had3"))
    by_stem = a.withColumn("s", boxes.path_name(F.col("rel_stem"))).join(img, F.col("s") == F.col("stem")).groupBy("annotation_path").agg(F.when(F.count("*") == 1, F.max("image")).alias("p4"), F.lit(True).alias("had4"))
    out = a.select("annotation_path")
    for part in (same_dir, same_stem, by_name, by_stem):
        out = out.join(part, "annotation_path", "left")
    found = F.coalesce("p1", "p2", "p3", "p4")
    return out.select("annotation_path", found.alias("image_path"), (found.isNull() & F.coalesce("had3", "had4", F.lit(False))).alias("ambiguous"))


def relocated(images: DataFrame, present: DataFrame, table_folder: str) -> DataFrame:
    """image_path, found: recorded paths that are gone, under the longest trailing folder they have below the table's.

    The new place is decided once a recorded folder, by its first missing path;
    a path that isn't there stays as recorded.
    """
    base = "/" + table_folder.strip("/")
    paths = images.select("image_path").distinct()
    gone = paths.join(present.select(F.col("path").alias("image_path")), "image_path", "left_anti")
    gone = gone.select("image_path", boxes.folder(F.col("image_path")).alias("dir"), boxes.path_name(F.col("image_path")).alias("name"))
    first = gone.groupBy("dir").agg(F.min("name").alias("name"))
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    tries = first.select("dir", "name", parts.alias("p")).select("dir", "name", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("keep"), "p")
    new_dir = F.concat_ws("/", F.lit(base), F.nullif(F.array_join(F.slice("p", F.size("p") - F.col("keep") + 1, F.col("keep")), "/"), F.lit("")))
    tries = tries.withColumn("new_dir", new_dir).withColumn("try", F.concat_ws("/", "new_dir", "name"))
    hit = tries.join(present.select(F.col("path").alias("try")), "try", "left_semi").groupBy("dir").agg(F.max_by("new_dir", "keep").alias("new_dir"))
    moved = gone.join(hit, "dir").select("image_path", F.concat_ws("/", "new_dir", "name").alias("path")).join(present.select("path"), "path", "left_semi")
    return paths.join(moved, "image_path", "left").select("image_path", F.coalesce("path", "image_path").alias("found"))


def pixel_rows(found: DataFrame, sizes: DataFrame, normalized: bool) -> DataFrame:
    """Boxes with image_path, as clamped whole pixels; ``reason`` says why a row is no box, or null."""
    sized = found.join(sizes, "image_path", "left")
    if normalized:
        raw = boxes.denormalised(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    else:
        raw = boxes.sides()
    fit: list[Column] = boxes.clamp_import(raw, F.col("width"), F.col("height"))
    for name, value in zip(boxes.SIDES, fit, strict=True):
        sized = sized.withColumn(f"_{name}", value)
    empty = raw[0].isNull()
    reason = F.when(F.col("image_path").isNull(), "no_image").when(F.col("width").isNull(), "unreadable").when(empty, "empty").when((F.col("_x_max") <= F.col("_x_min")) | (F.col("_y_max") <= F.col("_y_min")), "degenerate")
    return sized.withColumn("reason", reason).withColumns({s: F.col(f"_{s}").cast("float") for s in boxes.SIDES}).drop(*(f"_{s}" for s in boxes.SIDES))


def size_mismatches(annotations: DataFrame, sizes: DataFrame) -> DataFrame:
    """Annotations that declare another size than their image has; a warning only."""
    declared = annotations.select("annotation_path", "image_path", "declared_width", "declared_height").filter("declared_width is not null and declared_height is not null").distinct()
    return declared.join(sizes, "image_path").filter("declared_width <> width or declared_height <> height")


def import_counts(rows: DataFrame) -> DataFrame:
    """reason, n: what became of each row, counted from the rows themselves."""
    return rows.groupBy(F.coalesce("reason", F.lit("imported")).alias("reason")).agg(F.count("*").alias("n"))


#: Counters of an import, in the order in which they are reported.
COUNTERS = ("images", "boxes", "no_image", "empty", "already_present", "unreadable", "size_mismatch", "degenerate", "ambiguous", "skipped", "unlabelled")


def import_report(found: DataFrame, pairs: DataFrame, sizes: DataFrame, existing: DataFrame, images: DataFrame, normalized: bool, skip_existing: bool = True) -> tuple[DataFrame, DataFrame]:
    """The boxes to import as pixel rows, and (counter, n) of all that an import reports.

    ``found``: rows of ``yolo_boxes`` or ``voc_boxes``; ``pairs``: of ``paired``; ``existing``: image_path of the
    table; ``images``: the inventory (path). Files count once: without an image; else without a box; else with an
    image that the table has, or that an earlier file of this run took; else with an unreadable one; else, if the
    size differs from the declared one, as a warning. Boxes count if they have an area within the image.
    """
    skipped = F.coalesce(F.col("skipped"), F.lit(False)) if "skipped" in found.columns else F.lit(False)
    declared = all(c in found.columns for c in ("declared_width", "declared_height"))
    rows = cut(found.withColumn("_skip", skipped).join(pairs, "annotation_path").join(sizes, "image_path", "left"), "found")
    has_box = F.col("line").isNotNull() & F.col("label").isNotNull() & ~F.col("_skip")
    size = {c: F.max(c).alias(c) for c in ("declared_width", "declared_height") if declared}
    per = rows.groupBy("annotation_path").agg(F.max("image_path").alias("image_path"), F.max("ambiguous").alias("ambiguous"), F.count_if(has_box).alias("n"), F.count_if("_skip").alias("n_skipped"), F.max("width").alias("width"), F.max("height").alias("height"), *size.values())
    known = existing.select("image_path").distinct().withColumn("_known", F.lit(True))
    usable = rows.filter(has_box).join(known, "image_path", "left_anti") if skip_existing else rows.filter(has_box)
    fit = pixel_rows(usable.drop("width", "height"), sizes, normalized)
    first = fit.filter("reason is null").groupBy("image_path").agg(F.min("annotation_path").alias("_first"))
    per = per.join(known, "image_path", "left").join(first, "image_path", "left")
    again = F.col("_known").isNotNull() | (F.col("annotation_path") > F.col("_first")) if skip_existing else F.lit(False)
    mismatch = F.lit(False)
    if declared:
        mismatch = (F.col("declared_width") != 0) & (F.col("declared_height") != 0) & ((F.col("declared_width") != F.col("width")) | (F.col("declared_height") != F.col("height")))
    fate = F.when(F.col("image_path").isNull(), "no_image").when(F.col("n") == 0, "empty").when(F.coalesce(again, F.lit(False)), "already_present").when(F.col("width").isNull(), "unreadable").otherwise("taken")
    per = cut(per.withColumn("fate", fate).withColumn("mismatch", F.coalesce(mismatch, F.lit(False)) & (fate == "taken")), "per-file")
    taken = fit.join(per.filter("fate = 'taken'").select("annotation_path"), "annotation_path", "left_semi")
    good = taken.filter("reason is null")
    one = lambda df, name, n: df.agg(n.cast("long").alias("n")).select(F.lit(name).alias("counter"), "n")
    parts = [one(per, c, F.count_if(F.col("fate") == c)) for c in ("no_image", "empty", "already_present", "unreadable")]
    parts += [one(per, "size_mismatch", F.count_if("mismatch")), one(per, "ambiguous", F.count_if("ambiguous")), one(per, "skipped", F.coalesce(F.sum("n_skipped"), F.lit(0)))]
    parts += [one(good, "boxes", F.count("*")), one(good.select("image_path").distinct(), "images", F.count("*")), one(taken, "degenerate", F.count_if(F.col("reason") == "degenerate"))]
    unlabelled = images.select(F.col("path").alias("image_path")).join(per.filter("image_path is not null").select("image_path"), "image_path", "left_anti")
    parts.append(one(unlabelled, "unlabelled", F.count("*")))
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.union(p)
    return good, counts
