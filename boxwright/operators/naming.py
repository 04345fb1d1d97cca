"""Collision-free names, class tables, splits and files of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions import boxes, labels
from boxwright.sources import folder


def stem_map(images: DataFrame) -> DataFrame:
    """image_path, dest: the bare stem where it is unique in the export, else <parent>_<stem>.

    Stems are counted by aggregation and joined back, so that one stem shared by
    very many images stays spread out. Names that still clash are an error.
    """
    paths = images.select("image_path").distinct().withColumn("stem", boxes.stem(boxes.path_name(F.col("image_path"))))
    shared = paths.groupBy("stem").agg((F.count("*") > 1).alias("shared"))
    named = paths.join(shared, "stem").select("image_path", F.when(F.col("shared"), F.concat_ws("_", F.nullif(boxes.path_parent(F.col("image_path")), F.lit("")), "stem")).otherwise(F.col("stem")).alias("dest"))
    return named


def check_unique(named: DataFrame) -> DataFrame:
    """The same names, or an error if two images would be written under one."""
    clash = named.groupBy("dest").count().filter("count > 1").limit(3).collect()
    if clash:
        raise ValueError("names are not unique: " + ", ".join(r["dest"] for r in clash))
    return named


def manifest(images: DataFrame) -> DataFrame:
    return check_unique(stem_map(images)).select(F.col("image_path").alias("source_path"), F.concat("dest", boxes.suffix(boxes.path_name(F.col("image_path")))).alias("dest_filename")).orderBy("source_path")


def class_table(rows: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """idx, name: names in a fixed file's order, then unseen labels alphabetically (all of them without a file)."""
    found = rows.select(F.col("label").alias("name")).distinct()
    if fixed is None:
        return found.select((F.row_number().over(Window.orderBy("name")) - 1).alias("idx"), "name")
    new = found.join(fixed, "name", "left_anti")
    count = fixed.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("_n"))
    rest = new.crossJoin(F.broadcast(count)).select((F.row_number().over(Window.orderBy("name")) - 1 + F.col("_n")).cast("int").alias("idx"), "name")
    return fixed.select(F.col("idx").cast("int").alias("idx"), "name").unionByName(rest)


def case_clashes(classes: DataFrame, fixed: DataFrame) -> DataFrame:
    """New names that differ from a fixed one by case only."""
    new = classes.join(fixed.select("name"), "name", "left_anti")
    return new.join(fixed.select(F.col("name").alias("known")), F.lower("name") == F.lower("known")).select("name", "known")


def confident_images(rows: DataFrame, threshold: float | str) -> DataFrame:
    """Rows of images without an unverified box of null or low confidence; 'all' keeps every image.

    Over 1 the threshold is a percentage; outside 0 to 100 % it is an error.
    """
    if threshold == "all":
        return rows
    t = float(str(threshold).strip().rstrip("%"))
    t = t / 100 if t > 1 else t
    if not 0 <= t <= 1:
        raise ValueError(f"not a confidence: {threshold}")
    value = F.col("confidence").cast("double")
    bad = rows.filter(~labels.verified() & (value.isNull() | (value < t))).select("image_path").distinct()
    return rows.join(bad, "image_path", "left_anti")


def yolo_rows(rows: DataFrame, sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """image_path, idx and the four normalised numbers; images of unknown size have none."""
    joined = rows.withColumn("name", labels.export_label()).join(sizes, "image_path").join(F.broadcast(classes), "name")
    cx, cy, w, h = boxes.normalised(F.col("width"), F.col("height"))
    return joined.select("image_path", "id", "idx", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


def six_decimals(x: Column) -> Column:
    """A non-negative number with six decimals, rounded by its exact binary value and half to even.

    The exact product with 2,000,000 is a rounded one and its error, found by
    splitting x in two halves whose products are exact.
    """
    b = F.lit(2e6)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * b - x * b) + (x - high) * b
    q = F.floor(x * b / 2)
    rest = x * b - q * 2 + error
    n = q + F.when((rest > 1) | ((rest == 1) & (q % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("."), F.lpad((n % 1_000_000).cast("string"), 6, "0"))


def yolo_line() -> Column:
    """'idx cx cy w h' with six decimals."""
    return F.concat_ws(" ", F.col("idx").cast("string"), *(six_decimals(F.col(c)) for c in ("cx", "cy", "w", "h")))


def yolo_files(rows: DataFrame, names: DataFrame) -> DataFrame:
    """path, content: one label file an image."""
    line = yolo_line()
    per = rows.groupBy("image_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return per.join(check_unique(names), "image_path").select(F.concat("dest", F.lit(".txt")).alias("path"), F.concat("text", F.lit("\n")).alias("content"))


def pinned_images(images: DataFrame, pins: DataFrame) -> DataFrame:
    """Images (image_path, dest) that a list names: by new or old name, its stem, the full path, or ./images/..."""
    file = boxes.path_name(F.col("image_path"))
    forms = F.array(F.concat("dest", boxes.suffix(file)), F.col("dest"), file, boxes.stem(file), F.col("image_path"), F.concat(F.lit("./images/"), "dest", boxes.suffix(file)))
    wide = images.select("image_path", F.explode(F.array_distinct(forms)).alias("form"))
    return wide.join(pins.select(F.trim("name").alias("form")), "form", "left_semi").select("image_path").distinct()


def splits(images: DataFrame, train: int, val: int, test: int, seed: int, pins: DataFrame | None = None) -> DataFrame:
    """image_path, dest, split: max(pinned, int(N t%)) test, int(N v%) validation, the rest training.

    The order is by a seeded hash of the name. Where it is cut is found by counts of
    hash prefixes, and only images of one prefix are put in order, so nothing
    ranks all images. Pinned ones are test.
    """
    if min(train, val, test) < 0 or train + val + test != 100 or any(int(x) != x for x in (train, val, test)):
        raise ValueError("ratios are three whole numbers that sum to 100")
    marked = images.withColumn("_h", F.xxhash64("dest", F.lit(seed)))
    if pins is not None:
        marked = marked.join(pinned_images(images, pins).withColumn("_pin", F.lit(True)), "image_path", "left")
    else:
        marked = marked.withColumn("_pin", F.lit(None).cast("boolean"))
    marked = marked.withColumn("_pin", F.coalesce("_pin", F.lit(False)))
    n, pinned = marked.agg(F.count("*"), F.count_if("_pin")).first()
    n_test, n_val = max(pinned, n * test // 100) - pinned, n * val // 100
    free = marked.filter(~F.col("_pin")).select("_h", "dest")

    def bound(k: int) -> tuple | None:
        """The k-th image: by two counts of 65,536 prefixes at most, then among those that share 32 bits."""
        if k <= 0 or n == pinned:
            return None
        left, some = min(k, n - pinned), free
        for bits in (48, 32):
            for prefix, size in sorted((r["p"], r["count"]) for r in some.groupBy(F.shiftright("_h", bits).alias("p")).count().collect()):
                if left <= size:
                    some = some.filter(F.shiftright("_h", bits) == prefix)
                    break
                left -= size
        return some.orderBy("_h", "dest").offset(left - 1).limit(1).first()

    key = F.struct("_h", "dest")
    below = lambda b: F.lit(False) if b is None else key <= F.struct(F.lit(b["_h"]).cast("bigint").alias("_h"), F.lit(b["dest"]).alias("dest"))
    split = F.when(F.col("_pin") | below(bound(n_test)), "test").when(below(bound(n_test + n_val)), "val").otherwise("train")
    return marked.select("image_path", "dest", split.alias("split"))


def split_lists(assigned: DataFrame) -> DataFrame:
    """split, line: ./images/<stem><suffix>."""
    return assigned.select("split", F.concat(F.lit("./images/"), "dest", boxes.suffix(boxes.path_name(F.col("image_path")))).alias("line"))


def dataset_yaml(classes: DataFrame, counts: DataFrame, root: str = ".") -> str:
    """Text of the dataset file: splits with an image, number and names of classes."""
    have = {r["split"] for r in counts.filter("n > 0").collect()}
    names = [r["name"].replace("'", "''") for r in classes.orderBy("idx").collect()]
    lines = [f"path: {root}", *(f"{s}: {s}.txt" for s in ("train", "val", "test") if s in have), f"nc: {len(names)}", "names:", *(f"  {i}: '{x}'" for i, x in enumerate(names))]
    return "\n".join(lines) + "\n"


def xml_text(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def voc_objects(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row an object: corners cut to whole pixels, confidence as a decimal text of the widened number."""
    kept = rows.join(sizes, "image_path")
    return kept.select("image_path", "id", "width", "height", labels.export_label().alias("name"), F.col("confidence").cast("double").cast("string").alias("confidence"), *(F.col(s).cast("int").alias(s[0] + s[2:]) for s in boxes.SIDES))


def voc_files(objects: DataFrame, names: DataFrame) -> DataFrame:
    """path, content: one XML file an image."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), F.coalesce(value.cast("string"), F.lit("")), F.lit(f"</{name}>"))
    box = F.concat(*(tag(c, F.col(c)) for c in ("xmin", "ymin", "xmax", "ymax")))
    fixed = "<pose>Unspecified</pose><truncated>0</truncated><occluded>0</occluded><difficult>0</difficult>"
    one = F.concat(F.lit("<object>"), tag("name", xml_text(F.col("name"))), F.lit(fixed), tag("confidence", F.col("confidence")), F.lit("<bndbox>"), box, F.lit("</bndbox></object>"))
    per = objects.groupBy("image_path", "width", "height").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", one.alias("x")))), lambda s: s["x"]), "").alias("objects"))
    path = F.col("image_path")
    head = F.concat(tag("folder", xml_text(boxes.path_parent(path))), tag("filename", xml_text(boxes.path_name(path))), tag("path", xml_text(path)))
    size = F.concat(F.lit("<size>"), tag("width", F.col("width")), tag("height", F.col("height")), F.lit("<depth>3</depth></size>"))
    text = F.concat(F.lit("<annotation>"), head, size, "objects", F.lit("</annotation>\n"))
    return per.join(check_unique(names), "image_path").select(F.concat("dest", F.lit(".xml")).alias("path"), text.alias("content"))


ID_COLUMNS = "index,label,confidence,center_x,center_y,lon,lat,depth,tl_x,tl_y,tr_x,tr_y,br_x,br_y,bl_x,bl_y"


def id_rows(rows: DataFrame) -> DataFrame:
    """Identifications: 0-based index within the image by id, corners rounded once, centre their floor midpoint."""
    left, top, right, bottom = (F.bround(F.col(s).cast("double")).cast("int") for s in boxes.SIDES)
    nth = F.row_number().over(Window.partitionBy("image_path").orderBy("id")) - 1
    flat = rows.select("image_path", nth.alias("index"), labels.export_label().alias("label"), F.format_string("%.4f", F.col("confidence").cast("double")).alias("confidence"), left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"))
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("int")
    return flat.select("image_path", "index", "label", "confidence", mid("l", "r").alias("center_x"), mid("t", "b").alias("center_y"), F.col("l").alias("tl_x"), F.col("t").alias("tl_y"), F.col("r").alias("br_x"), F.col("b").alias("br_y"))


def csv_text(text: Column) -> Column:
    """A field quoted only if it needs to be."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def id_files(ids: DataFrame, sizes: DataFrame, names: DataFrame | None, user: str, generated_at: str, model: str) -> DataFrame:
    """path, content: header and rows; beside the image, or under its collision-free name."""
    c = lambda n: F.col(n).cast("string")
    zero = F.lit("0.0")
    row = F.concat_ws(",", c("index"), csv_text(F.col("label")), F.col("confidence"), c("center_x"), c("center_y"), zero, zero, zero, c("tl_x"), c("tl_y"), c("br_x"), c("tl_y"), c("br_x"), c("br_y"), c("tl_x"), c("br_y"))
    per = ids.groupBy("image_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", row.alias("x")))), lambda s: s["x"]), "\n").alias("rows"), F.count("*").alias("n"))
    if names is None:
        check_unique(per.select(boxes.stem(F.col("image_path")).alias("dest")))
    per = per.join(sizes, "image_path", "left")
    size = lambda n: F.concat(F.lit(f"# image_{n}: "), F.coalesce(F.col(n).cast("string"), F.lit("unknown")))
    legend = "# corners are box edges in pixels from the top left; the centre is the midpoint of the corners\n# lon, lat, depth stand for the centre and are filled in later"
    text = F.concat_ws("\n", F.lit(f"# generated_by: {user}"), F.lit(f"# generated_at: {generated_at}"), F.lit(f"# model: {model}"), F.concat(F.lit("# source_image: "), "image_path"), size("width"), size("height"), F.concat(F.lit("# count: "), F.col("n").cast("string")), F.lit(legend), F.lit("# " + ID_COLUMNS), "rows", F.lit(""))
    if names is None:
        return per.select(F.concat(boxes.stem(F.col("image_path")), F.lit(".id")).alias("path"), text.alias("content"))
    return per.join(check_unique(names), "image_path").select(F.concat("dest", F.lit(".id")).alias("path"), text.alias("content"))


def gallery_rows(rows: DataFrame, per_page: int = 250) -> DataFrame:
    """image_path, page and its distinct crops; pages hold ``per_page`` images in path order."""
    from boxwright.operators.mutations import dense_ids

    crops = rows.select("image_path", *boxes.SIDES, labels.export_label().alias("label")).distinct()
    images = dense_ids(rows.select("image_path").distinct(), ["image_path"], name="_nth").select("image_path", F.floor(F.col("_nth") / per_page).cast("int").alias("page"))
    return crops.join(images, "image_path")


def gallery_pages(crops: DataFrame, title: str = "Gallery") -> DataFrame:
    """path, content: HTML pages that point at images and crops."""
    figure = F.concat(F.lit("<figure data-box='"), F.concat_ws(",", *(F.col(s).cast("int").cast("string") for s in boxes.SIDES)), F.lit("'>"), xml_text(F.col("label")), F.lit("</figure>"))
    images = crops.groupBy("page", "image_path").agg(F.array_join(F.sort_array(F.collect_list(figure)), "").alias("figures"))
    section = F.concat(F.lit("<section><h2>"), xml_text(F.col("image_path")), F.lit("</h2><img src='"), xml_text(F.col("image_path")), F.lit("'>"), "figures", F.lit("</section>"))
    pages = images.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("image_path", section.alias("x")))), lambda s: s["x"]), "\n").alias("body"))
    last = F.broadcast(pages.agg(F.max("page").alias("last")))
    link = lambda n, text: F.concat(F.lit("<a href='page_"), n.cast("string"), F.lit(f".html'>{text}</a>"))
    nav = F.concat(F.when(F.col("page") > 0, link(F.col("page") - 1, "previous")).otherwise(""), F.when(F.col("page") < F.col("last"), link(F.col("page") + 1, "next")).otherwise(""))
    html = F.concat(F.lit(f"<!doctype html><title>{title}</title>"), nav, F.lit("\n"), "body", F.lit("\n"))
    return pages.crossJoin(last).select(F.format_string("page_%d.html", "page").alias("path"), html.alias("content"))


def write_files(files: DataFrame, root: str) -> tuple[int, int]:
    """One file a row of (path, content), written by the executors; (written, failed).

    ``root`` is a folder that they share, on any file system that Arrow knows (a
    local or mounted path, file:, hdfs:, s3:, gs:, abfs:); another is an error.
    Files appear under their names when all are written; if the job fails, none is left.
    ``folder.write`` also names those that failed.
    """
    written, failed = folder.write(files, root)
    return written, len(failed)
