import csv
import os
import random

from boxwright.operators import matrices

DDL = "row string, col string, n bigint"


def table(lines):
    return list(csv.reader(r["line"] for r in lines.orderBy("nth").collect()))


def test_matrix_against_a_plain_one(spark):
    rng = random.Random(5)
    rows = [f"r{i}" for i in range(40)] + ["", "a,b", 'say "x"', None]
    cols = [f"c{i:03}" for i in range(60)] + ["", "x,y", None]
    given = [(rng.choice(rows), rng.choice(cols), rng.randrange(1, 9)) for _ in range(700)]
    want: dict = {}
    for r, c, n in given:
        want[r or "", c or ""] = want.get((r or "", c or ""), 0) + n
    names, across = sorted({r for r, _ in want}), sorted({c for _, c in want})
    found = matrices.matrix_lines(spark.createDataFrame(given, DDL), "row", "col", "n", "name")
    assert table(found) == [["name", *across]] + [[r, *(str(want.get((r, c), 0)) for c in across)] for r in names]
    assert [r["nth"] for r in found.orderBy("nth").collect()] == list(range(len(names) + 1))


def test_one_cell_and_none(spark):
    one = matrices.matrix_lines(spark.createDataFrame([("r", "c", 3)], DDL), "row", "col", "n", "name")
    assert table(one) == [["name", "c"], ["r", "3"]]
    none = matrices.matrix_lines(spark.createDataFrame([], DDL), "row", "col", "n", "name")
    assert table(none) == [["name"]]


def test_images_of_one_stem_and_files_in_order(spark, tmp_path):
    rows = [("/a/x.png", "x.png", "crab", None, 1), ("/b/x.png", "x.png", "crab", "star", 1), ("/b/y.png", "y.png", "crab", None, 1), ("/b/y.png", "y.png", "crab", "noise", 1), ("/c/z.png", "z.png", "crab", None, 0)]
    df = spark.createDataFrame(rows, "image_path string, image_name string, label string, new_label string, verified int")
    assert table(matrices.image_label_lines(df)) == [["image", "crab", "star"], ["a_x", "1", "0"], ["b_x", "0", "1"], ["y", "1", "0"]]
    lines = matrices.taxa_lines(df)
    assert table(lines) == [["taxa", "x.png", "y.png", "z.png"], ["crab", "2", "2", "1"]]
    matrices.write_matrix(lines, str(tmp_path / "m"))
    parts = sorted(p for p in os.listdir(tmp_path / "m") if p.startswith("part"))
    assert "".join((tmp_path / "m" / p).read_text() for p in parts) == "taxa,x.png,y.png,z.png\ncrab,2,2,1\n"
