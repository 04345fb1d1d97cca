import pytest
from pyspark.sql import functions as F

from boxwright.operators import naming
from boxwright.sources import files, folder

NAMES = "idx int, name string"


def test_label_lines_in_every_form(spark, tmp_path):
    root = tmp_path / "lab dir+1" / "süb %20x"
    root.mkdir(parents=True)
    (root / "im g.txt").write_text("0.0 0.5 0.5 0.2 0.2\r\n\t1\t0.5  0.5 0.2 0.4\t0.75 \n1.9 0.1 0.1 0.3 0.1 0.2 0.5\n")
    (root / "empty.txt").write_text("")
    (root / "blank.TXT").write_text(" \n\t\n")
    for n in ("Classes.txt", "names.txt", "NOTES.txt"):
        (root / n).write_text("crab\n")
    base = str(tmp_path / "lab dir+1")
    got = files.yolo_boxes(spark, base, spark.createDataFrame([(0, "crab"), (1, "sponge")], NAMES)).orderBy("rel_stem", "line").collect()
    assert [(r["rel_stem"], r["line"], r["label"]) for r in got] == [("süb %20x/blank", None, None), ("süb %20x/empty", None, None), *(("süb %20x/im g", i, n) for i, n in enumerate(["crab", "sponge", "sponge"]))]
    assert got[3]["confidence"] == 0.75 and got[0]["annotation_path"] == f"{base}/süb %20x/blank.TXT"
    images = spark.createDataFrame([(f"{tmp_path}/img/süb %20x/im g.png",)], "path string")
    notes = spark.createDataFrame([(r["annotation_path"], r["rel_stem"], None, None) for r in got], "annotation_path string, rel_stem string, filename string, folder string")
    pairs = {r["annotation_path"].rpartition("/")[2]: r["image_path"] for r in files.paired(notes, images, f"{tmp_path}/img").collect()}
    assert pairs == {"im g.txt": f"{tmp_path}/img/süb %20x/im g.png", "empty.txt": None, "blank.TXT": None}
    for bad in ("x 0.5 0.5 0.2 0.2", "2 0.5 0.5 0.2 0.2", "-1 0.5 0.5 0.2 0.2", "0 0.5 0.5 0.2", "0 a b c d", "0"):
        (root / "z.txt").write_text(bad)
        with pytest.raises(ValueError, match="z.txt"):
            files.yolo_boxes(spark, base, spark.createDataFrame([(0, "crab"), (1, "sponge")], NAMES))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.yolo_boxes(spark, str(tmp_path / "none"), spark.createDataFrame([(0, "crab")], NAMES))


@pytest.mark.parametrize(
    ("name", "text", "expected"),
    [
        ("a.txt", " crab \n\nsea star\r\n", ["crab", "sea star"]),
        ("a.yaml", "nc: 2\nnames: {1: b, 0: a}\n", ["a", "b"]),
        ("a.yml", "names: ['a, b', \"it's\", c]\n", ["a, b", "it's", "c"]),
        ("A.YAML", "names:\n  - a\n  - 'b: c'\ntrain: x\n", ["a", "b: c"]),
        ("a.yaml", "names:\n  2: z\n  10: y # last\n", ["z", "y"]),
        ("a.yaml", "names: [1, 2.5]\n", ["1", "2.5"]),
    ],
)
def test_names_files(spark, tmp_path, name, text, expected):
    (tmp_path / name).write_text(text)
    assert [r["name"] for r in files.names_file(spark, str(tmp_path / name)).orderBy("idx").collect()] == expected


@pytest.mark.parametrize(("name", "text"), [("a.txt", "a\nb\na\n"), ("a.yaml", "names: [a, a]"), ("a.yaml", "path: x"), ("a.yaml", ""), ("a.txt", "\n")])
def test_names_files_that_are_none(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    with pytest.raises(ValueError):
        files.names_file(spark, str(tmp_path / name))


def test_voc_in_a_folder_with_blanks(spark, tmp_path):
    (tmp_path / "a b" / "ü").mkdir(parents=True)
    (tmp_path / "a b" / "ü" / "x 1.xml").write_text("<annotation><filename>x 1.png</filename><object><name>crab</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object><object><name>no box</name></object></annotation>")
    rows = files.voc_boxes(spark, str(tmp_path / "a b")).orderBy("line").collect()
    assert [(r["rel_stem"], r["skipped"]) for r in rows] == [("ü/x 1", False), ("ü/x 1", True)]
    images = spark.createDataFrame([(f"{tmp_path}/img/ü/x 1.png",)], "path string")
    notes = spark.createDataFrame([tuple(rows[0][c] for c in ("annotation_path", "rel_stem", "filename", "folder"))], "annotation_path string, rel_stem string, filename string, folder string")
    assert files.paired(notes, images, f"{tmp_path}/img").first()["image_path"] == f"{tmp_path}/img/ü/x 1.png"


def test_remap_lists(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes('﻿a, b\n\n c ,\n"x, y","two\nlines"\na,z\n'.encode())
    got = [(r["old_label"], r["new_label"]) for r in files.remap_csv(spark, str(tmp_path / "r.csv")).orderBy("line").collect()]
    assert got == [("a", "b"), ("c", ""), ("x, y", "two\nlines"), ("a", "z")]
    for bad in ("a\n", "a,b,\n", "a,b,c\n", "ok,ok\n  \n"):
        (tmp_path / "r.csv").write_text(bad)
        with pytest.raises(ValueError):
            files.remap_csv(spark, str(tmp_path / "r.csv"))
    (tmp_path / "r.csv").write_text("")
    assert files.remap_csv(spark, str(tmp_path / "r.csv")).count() == 0


def test_the_whole_report_of_an_import(spark):
    note = lambda a, line, label, x=1.0, skip=False, size=20: (a, "s", None, None, size, 10, line, label, x, 1.0, 9.0, 8.0, None, skip)
    ddl = "annotation_path string, rel_stem string, filename string, folder string, declared_width int, declared_height int, line int, label string, x_min double, y_min double, x_max double, y_max double, confidence double, skipped boolean"
    found = [note("1", 0, "a"), note("1", 1, "a", 9.0), note("1", 2, None, skip=True), note("2", 0, "a"), note("3", None, None), note("4", 0, "b"), note("5", 0, "b"), note("6", 0, "a"), note("7", 0, "a", size=21), note("8", 0, "x", 9.0), note("9", 0, "x")]
    pairs = [("1", "/1", False), ("2", None, True), ("3", "/3", False), ("4", "/old", False), ("5", "/bad", False), ("6", "/1", False), ("7", "/7", False), ("8", "/8", False), ("9", None, False)]
    frame = lambda rows, d: spark.createDataFrame(rows, d)
    sizes = frame([(p, 20, 10) for p in ("/1", "/3", "/old", "/7", "/8", "/spare")], "image_path string, width int, height int")
    images = frame([(p,) for p in ("/1", "/3", "/old", "/bad", "/7", "/8", "/spare")], "path string")
    args = frame(found, ddl), frame(pairs, "annotation_path string, image_path string, ambiguous boolean"), sizes, frame([("/old",)], "image_path string"), images, False
    good, counts = files.import_report(*args)
    assert {r["counter"]: r["n"] for r in counts.collect()} == {"images": 2, "boxes": 2, "no_image": 2, "empty": 1, "already_present": 2, "unreadable": 1, "size_mismatch": 1, "degenerate": 2, "ambiguous": 1, "skipped": 1, "unlabelled": 1}
    assert sorted((r["annotation_path"], r["line"]) for r in good.collect()) == [("1", 0), ("7", 0)]
    assert {r["counter"]: r["n"] for r in files.import_report(*args, skip_existing=False)[1].collect()}["already_present"] == 0
    assert set(files.COUNTERS) == {r["counter"] for r in counts.collect()}


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/{i}.txt", "x" * i, i) for i in range(60)], "path string, content string, i int").repartition(4)
    failing = rows.withColumn("content", F.when(F.col("i") == 47, F.raise_error(F.lit("half-way"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="half-way"):
        folder.write(failing, str(tmp_path))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    assert folder.write(rows, f"file://{tmp_path}") == (60, [])
    assert (tmp_path / "d2" / "47.txt").read_text() == "x" * 47 and len([p for p in tmp_path.rglob("*") if p.is_file()]) == 60
    got = {r["path"]: r["size"] for r in folder.listing(spark, str(tmp_path)).collect()}
    assert got == {f"{tmp_path}/d{i % 3}/{i}.txt": i for i in range(60)}  # the one of zero bytes too


def test_files_that_cannot_be_written_are_named(spark, tmp_path):
    (tmp_path / "taken").mkdir()
    (tmp_path / "b.txt").write_text("old")
    rows = spark.createDataFrame([("a.txt", b"1"), ("taken", b"2"), ("b.txt/c.txt", b"3")], "path string, content binary").coalesce(1)
    assert folder.write(rows, str(tmp_path)) == (1, ["b.txt/c.txt", "taken"])
    assert not list(tmp_path.glob(".*")) and (tmp_path / "a.txt").read_bytes() == b"1"


def test_sidecars_that_would_share_a_name_are_an_error(spark):
    rows = spark.createDataFrame([(1, "/d/a.png", 1.5, 2.5, 10.0, 8.0, 0.25, "a", None), (2, "/d/a.jpg", 0.0, 0.0, 4.0, 4.0, 1.0, "c", None)], "id int, image_path string, x_min float, y_min float, x_max float, y_max float, confidence float, label string, new_label string")
    sizes = spark.createDataFrame([], "image_path string, width int, height int")
    with pytest.raises(ValueError, match="/d/a"):
        naming.id_files(naming.id_rows(rows), sizes, None, "me", "t", "m")


def test_new_names_that_differ_by_case_only(spark):
    got = naming.case_clashes(spark.createDataFrame([(0, "Crab"), (1, "star")], NAMES), spark.createDataFrame([(0, "crab")], NAMES)).collect()
    assert [tuple(r) for r in got] == [("Crab", "crab")]
