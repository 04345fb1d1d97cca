import duckdb
import pytest
from pyspark.sql import functions as F

from boxwright import schema
from boxwright.functions import boxes, labels
from boxwright.operators import clustering, linking, mutations, naming, pixels, review, vectors
from boxwright.plans import detection_queries
from boxwright.session import SHUFFLE_CLEANUP, cut, scratch_path
from boxwright.sources import detections, files

SF = "/root/testdata/sf0.001"
SLOW = {"cluster_embeddings", "refine_label"}


def plain(value):
    if value is None or isinstance(value, float) and value != value:
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(detection_queries.queries()) - SLOW))
def test_query_against_duckdb(spark, duck, name):
    got = detection_queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    sql = detection_queries.oracle_sql().get(name)
    if sql is None:
        assert rows or name == "fixture_merge"  # too few frames for pieces at this size
        return
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert rows == sorted((tuple(plain(v) for v in r) for r in duck.sql(f"SELECT {quoted} FROM ({sql}) AS t").fetchall()), key=repr)


def df(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_labels_swap(spark):
    t = df(spark, [(1, "A"), (2, "B"), (3, None)], "id int, new_label string")
    out, counts = mutations.remap_labels(t, df(spark, [("A", "B"), ("B", "A"), ("C", "x")], "old_label string, new_label string"))
    assert [r["new_label"] for r in out.orderBy("id").collect()] == ["B", "A", None]
    assert {r["old_label"]: r["n"] for r in counts.collect()} == {"A": 1, "B": 1, "C": 0}


def test_appended_ids_go_on(spark):
    t = df(spark, [], schema.PREDICTIONS)
    stills = df(spark, [(f"/a/{i}.png", "x") for i in range(5)], "image_path string, label string")
    videos = df(spark, [(f"/v/{i}.png", "x") for i in range(4)], "image_path string, label string")
    t = mutations.append(mutations.append(t, stills, ["image_path"]), videos, ["image_path"])
    assert [(r["id"], r["image_path"][:2]) for r in t.orderBy("id").collect()] == [(i, "/a") for i in range(5)] + [(i, "/v") for i in range(5, 9)]


def test_confidence_ends_are_inclusive_and_null_shows_at_full_range_only(spark):
    t = df(spark, [(1, 0.3), (2, 0.7), (3, 0.29), (4, None)], "id int, confidence float")
    ids = lambda *r: [x["id"] for x in t.filter(labels.confidence_range(*r)).orderBy("id").collect()]
    assert ids(0.3, 0.7) == [1, 2] and ids(0, 1) == [1, 2, 3, 4] and ids(None, 0.5) == [1, 3]


def test_sort_text_and_empty_sort():
    assert labels.sort_text([("New Label", None), ("Box Size", True)]) == "New Label (A-Z), then Box Size (high-low)"
    with pytest.raises(ValueError):
        labels.sort_columns([])


def test_pages_cover_every_row_once(spark):
    t = df(spark, [(i, "a" if i % 3 else None, float(i % 5), "l", "n", 0.5, 1) for i in range(47)], "id int, new_label string, sharpness double, label string, image_name string, confidence double, verified int")
    seen = [r["id"] for k in range(0, 47, 10) for r in review.page(t, [("New Label", None), ("Sharpness", None)], k, 10).collect()]
    assert sorted(seen) == list(range(47)) and len(seen) == 47


def test_cluster_names(spark):
    same = df(spark, [(i, "object") for i in range(6)], "cluster int, label string")
    names = lambda d, n: [r["name"] for r in clustering.cluster_names(d, n).orderBy("cluster").collect()]
    assert names(same, "auto") == [f"object_{i}" for i in range(1, 7)] and names(same, "dominant") == ["object"] * 6
    mixed = df(spark, [(0, "a"), (1, "b"), (2, "a")], "cluster int, label string")
    assert names(mixed, "auto") == ["a_1", "b", "a_2"] and names(mixed, "indexed") == ["a_1", "b_1", "a_2"]


def test_clusters_find_groups_and_noise(spark):
    import numpy as np

    r = np.random.default_rng(0)
    centres = np.eye(8)[:3]
    rows = [(i, (centres[i % 3] + r.normal(0, 0.02, 8)).tolist()) for i in range(60)] + [(60 + i, r.normal(0, 1, 8).tolist()) for i in range(4)]
    found = clustering.clusters(df(spark, rows, "roi_index int, embedding array<float>"), n_neighbors=10, approx_n_clusters=3, base_min_cluster_size=5)
    got = {x["roi_index"]: x["cluster"] for x in found.collect()}
    assert len(got) == 64 and len({got[i] for i in range(0, 60, 3)} - {-1}) == 1 and len({got[i] for i in range(60)} - {-1}) == 3
    assert clustering.clusters(df(spark, rows[:5], "roi_index int, embedding array<float>")) is None


@pytest.mark.parametrize(("n", "mode", "frame"), [(1, "best-conf-third", 0), (2, "best-conf-third", 0), (3, "best-conf-third", 1), (7, "best-conf-third", 2), (7, "center", 3), (4, "best-conf", 0)])
def test_track_representatives(spark, n, mode, frame):
    t = df(spark, [("v", 1, f, 0.5, 0.0, 0) for f in range(n)], "video_path string, track_id int, frame_number int, confidence double, sharpness double, class_id int")
    assert detections.representatives(t, mode).first()["frame_number"] == frame


def test_linking_gaps(spark):
    box = lambda x: (float(x), 0.0, float(x + 40), 30.0)
    rows = [("c", f, f, *box(0)) for f in range(30)] + [("c", 40, 100, *box(1)), ("c", 200, 101, *box(0)), ("d", 1, 102, *box(0)), ("c", 5, 103, *box(5))]
    got = {r["roi_index"]: (r["camera"], r["track"]) for r in linking.link(df(spark, rows, "camera string, frame int, roi_index int, x_min float, y_min float, x_max float, y_max float")).collect()}
    assert len({got[i] for i in range(30)}) == 1 and got[100] == got[0] and got[101] != got[0] and got[103] != got[5] and got[102][0] == "d"


def test_import_yolo_and_errors(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("0 0.5 0.5 0.2 0.2\n\n1 0.5 0.5 0.2 0.4 0.75\n1 0.1 0.1 0.3 0.1 0.2 0.5\n")
    (tmp_path / "a" / "y.txt").write_text("\n")
    (tmp_path / "names.txt").write_text("crab\nsponge\n")
    names = files.names_file(spark, f"{tmp_path}/names.txt")
    got = files.yolo_boxes(spark, str(tmp_path), names).orderBy("rel_stem", "line").collect()
    assert [(r["rel_stem"], r["line"], r["label"]) for r in got] == [("a/x", 0, "crab"), ("a/x", 1, "sponge"), ("a/x", 2, "sponge"), ("a/y", None, None)]
    assert got[1]["confidence"] == 0.75 and (round(got[2]["cx"], 6), round(got[2]["h"], 6)) == (0.2, 0.4)
    (tmp_path / "a" / "z.txt").write_text("7 0.5 0.5 0.2 0.2\n")
    with pytest.raises(ValueError, match="z.txt"):
        files.yolo_boxes(spark, str(tmp_path), names)


def test_pairing_prefers_the_nearest(spark):
    images = df(spark, [("/i/train/a.jpg",), ("/i/val/a.jpg",), ("/i/b.png",), ("/i/val/c.jpg",)], "path string")
    notes = df(spark, [("1", "train_a", "a.jpg", "train"), ("2", "flat/a", "a.jpg", None), ("3", "val/c", None, None), ("4", "z/b", None, None), ("5", "nope", None, None)], "annotation_path string, rel_stem string, filename string, folder string")
    got = {r["annotation_path"]: (r["image_path"], r["ambiguous"]) for r in files.paired(notes, images, "/i").collect()}
    assert got == {"1": ("/i/train/a.jpg", False), "2": (None, True), "3": ("/i/val/c.jpg", False), "4": ("/i/b.png", False), "5": (None, False)}


def test_lists_and_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿a, b\n\nc,d\na,z\n")
    rules = mutations.remap_rules(files.remap_csv(spark, str(tmp_path / "r.csv")))
    assert {(r["old_label"], r["new_label"]) for r in rules.collect()} == {("a", "z"), ("c", "d")}
    (tmp_path / "bad.csv").write_text("a,b,c\n")
    with pytest.raises(ValueError):
        files.remap_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "l.csv").write_text("ID,Note\n7,x\n,\n5.0,y\n7,z\n")
    got = [(r["roi_index"], r["note"]) for r in files.box_list_csv(spark, str(tmp_path / "l.csv")).orderBy("pos").collect()]
    assert got == [(7, "x"), (5, "y")]
    (tmp_path / "p.txt").write_text("# all\n a \n\nb # x\n\timg#1.png\n  # no\n")
    assert [r["name"] for r in files.pinned_list(spark, str(tmp_path / "p.txt")).collect()] == ["a", "b # x", "img#1.png"]


def test_voc_round_trip_keeps_confidence(spark, tmp_path):
    rows = df(spark, [(1, "/d/a.png", 1.7, 2.0, 9.9, 8.0, 0.7, "x<y&", None, 1)], "id int, image_path string, x_min float, y_min float, x_max float, y_max float, confidence float, label string, new_label string, verified int")
    sizes = df(spark, [("/d/a.png", 20, 10)], "image_path string, width int, height int")
    out = naming.voc_files(naming.voc_objects(rows, sizes), naming.stem_map(rows))
    assert naming.write_files(out, str(tmp_path)) == (1, 0)
    r = files.voc_boxes(spark, str(tmp_path)).first()
    assert (r["label"], r["x_min"], r["declared_width"]) == ("x<y&", 1.0, 20) and float(r["confidence"]) == float(rows.select(F.col("confidence").cast("double")).first()[0])


def test_splits_are_exclusive_and_pins_are_tested(spark):
    images = naming.stem_map(df(spark, [(f"/d/{i}.png",) for i in range(50)], "image_path string"))
    got = naming.splits(images, 70, 20, 10, 1, df(spark, [("3",), ("/d/4.png",)], "name string")).collect()
    assert len(got) == 50 and {r["split"] for r in got if r["dest"] in ("3", "4")} == {"test"}
    assert [sum(r["split"] == s for r in got) for s in ("train", "val", "test")] == [35, 10, 5]
    with pytest.raises(ValueError):
        naming.splits(images, 70, 20, 11, 1)
    text = naming.dataset_yaml(df(spark, [(0, "it's")], "idx int, name string"), df(spark, [("train", 3), ("val", 0)], "split string, n int"))
    assert "train: train.txt" in text and "val:" not in text and "'it''s'" in text


def test_id_gallery_and_label_files(spark):
    rows = df(spark, [(1, "/d/a.png", 1.5, 2.5, 10.0, 8.0, 0.25, "a,b", None, 1), (2, "/d/a.png", 0.0, 0.0, 4.0, 4.0, 1.0, "c", "<c>", 1)], "id int, image_path string, x_min float, y_min float, x_max float, y_max float, confidence float, label string, new_label string, verified int")
    sizes, names = df(spark, [("/d/a.png", 20, 10)], "image_path string, width int, height int"), naming.stem_map(rows)
    r = naming.id_files(naming.id_rows(rows), sizes, names, "me", "2020-01-01T00:00:00Z", "m").first()
    lines = r["content"].splitlines()
    assert r["path"] == "a.id" and "# image_width: 20" in lines and "# count: 2" in lines
    assert lines[-2:] == ['0,"a,b",0.2500,6,5,0.0,0.0,0.0,2,2,10,2,10,8,2,8', "1,<c>,1.0000,2,2,0.0,0.0,0.0,0,0,4,0,4,4,0,4"]
    beside = naming.id_files(naming.id_rows(rows), sizes.limit(0), None, "me", "t", "m").first()
    assert beside["path"] == "/d/a.id" and "# image_width: unknown" in beside["content"]
    pages = naming.gallery_pages(naming.gallery_rows(rows, 1)).collect()
    assert [p["path"] for p in pages] == ["page_0.html"] and "&lt;c&gt;" in pages[0]["content"] and "next" not in pages[0]["content"]
    classes = naming.class_table(rows.select(labels.export_label().alias("label")))
    text = naming.yolo_files(naming.yolo_rows(rows, sizes, classes), names).first()
    assert text["path"] == "a.txt" and text["content"] == "1 0.287500 0.525000 0.425000 0.550000\n0 0.100000 0.200000 0.200000 0.400000\n"


def test_stream_keeps_all_rows_of_an_image_in_two_files(spark):
    from boxwright.streaming.ingest import incremental

    from boxwright.store import Store

    root, cols = scratch_path(spark, "stream"), "id int, roi_index int, image_path string, label string"
    store = Store(spark, f"{root}/store")
    store.write(predictions=df(spark, [(4, 4, "/old.png", "x")], cols))
    for k, label in enumerate("ab"):
        df(spark, [(None, None, "/one.png", f"{label}{i}") for i in range(3)], cols).coalesce(1).write.parquet(f"{root}/in/{k}")
    df(spark, [(None, None, "/old.png", "again")], cols).coalesce(1).write.parquet(f"{root}/in/2")
    for _ in range(2):
        incremental(spark, f"{root}/in/*", cols, store, f"{root}/checkpoint", ["image_path", "label"], known_images=True)
    got = store.read("predictions").collect()
    assert sorted((r["image_path"], r["label"]) for r in got) == [("/old.png", "x")] + [("/one.png", f"{a}{i}") for a in "ab" for i in range(3)]
    assert sorted(r["id"] for r in got) == list(range(4, 11)) and all(r["id"] == r["roi_index"] for r in got)


def test_scratch_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from boxwright import session

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Cluster.conf)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Cluster)


def test_late_pages_and_splits_need_no_top_k_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(review, "FRONT", 10)
    t = df(spark, [(i, f"/i{i % 7}.png", (i * 37) % 101 / 100, None if i % 5 else "x", "b", 0) for i in range(1000)], "id int, image_path string, confidence double, new_label string, label string, verified int")
    whole = [r["id"] for r in t.orderBy(*labels.sort_columns([("confidence", True)])).collect()]
    for offset in (0, 7, 500, 985, 1000):
        got = review.page(t, [("confidence", True)], offset, 25).collect()
        assert [r["id"] for r in got] == whole[offset : offset + 25] and [r["rank"] for r in got] == list(range(offset + 1, min(1000, offset + 25) + 1))
    images = df(spark, [(f"/s/{i}.png", f"{i}") for i in range(500)], "image_path string, dest string")
    asked = []
    monkeypatch.setattr(type(images), "limit", lambda self, n, f=type(images).limit: asked.append(n) or f(self, n))
    got = naming.splits(images, 70, 20, 10, 3)
    order = [r["dest"] for r in images.orderBy(F.xxhash64("dest", F.lit(3)), "dest").collect()]
    assert {r["split"]: r["n"] for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"test": 50, "val": 100, "train": 350}
    assert {r["dest"] for r in got.filter("split = 'test'").collect()} == set(order[:50]) and set(asked) == {1}


def test_polygons_of_any_length(spark, tmp_path):
    points = " ".join(f"0.{1 + i % 3} 0.2" for i in range(6000))
    (tmp_path / "a.txt").write_text(f"0 {points} 0.9 0.8\n")
    r = files.yolo_boxes(spark, str(tmp_path), df(spark, [(0, "x")], "idx int, name string")).first()
    assert abs(r["w"] - 0.8) < 1e-9 and abs(r["h"] - 0.6) < 1e-9


def test_names_that_clash_are_an_error(spark):
    same = df(spark, [("/a/b/x.png",), ("/c/b/x.jpg",)], "image_path string")
    with pytest.raises(ValueError, match="b_x"):
        naming.manifest(same)


def test_write_files_counts_failures(spark, tmp_path):
    files_ = df(spark, [("a/b.txt", "one"), ("c.txt", "two"), ("a/b.txt/d.txt", "a file stands there")], "path string, content string").coalesce(1)
    assert naming.write_files(files_.orderBy("path"), f"file://{tmp_path}") == (2, 1)
    assert (tmp_path / "a/b.txt").read_text() == "one" and not list(tmp_path.rglob("*.part"))


def test_exact_neighbours_in_parts(spark):
    import numpy as np

    r = np.random.default_rng(4)
    v = r.normal(size=(300, 5))
    v[200:220] = v[:20]  # ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = clustering.neighbours(df(spark, [(i, x.tolist()) for i, x in enumerate(v)], "roi_index int, u array<double>"), 4, side_rows=70).collect()
    d = np.sqrt(np.clip(2 - 2 * v @ v.T, 0, None))
    np.fill_diagonal(d, np.inf)
    expected = {(i, round(x, 6)) for i in range(300) for x in np.sort(d[i])[:4]}
    assert len(got) == 1200 and {(x["a"], round(x["d"], 6)) for x in got} == expected


def test_crops_and_sharpness_known_answers(spark):
    import numpy as np

    px = np.arange(6 * 8, dtype=np.uint8).reshape(6, 8)
    pictures = df(spark, [("/p.png", 8, 6, 1, bytearray(px.tobytes()))], "image_path string, width int, height int, channels int, data binary")
    rows = df(spark, [(1, "/p.png", 2.0, 1.0, 5.0, 4.0), (2, "/p.png", -3.0, -3.0, 2.9, 1.5), (3, "/p.png", 20.0, 20.0, 30.0, 30.0)], "roi_index int, image_path string, x_min float, y_min float, x_max float, y_max float")
    got = {r["roi_index"]: r for r in pixels.crops(pictures, rows).collect()}
    assert bytes(got[1]["data"]) == px[1:4, 2:5].tobytes() and (got[1]["width"], got[1]["height"]) == (3, 3)
    assert bytes(got[2]["data"]) == px[0:1, 0:2].tobytes() and bytes(got[3]["data"]) == b""
    spot = np.zeros((5, 5), np.uint8)
    spot[2, 2] = 10
    # The Laplacian is -40 at the spot, 10 at its four neighbours, 0 elsewhere.
    assert abs(pixels.sharpness_of(spot.tobytes(), 5, 5, 1) - (1600 + 4 * 100) / 25) < 1e-9


def test_fixtures_from_end_to_end(spark):
    import numpy as np

    r = np.random.default_rng(1)
    looks = np.eye(8)
    rows, want = [], {}
    for frame in range(60):
        for slot in range(4):
            if slot == 3 and 20 <= frame < 58:  # away for longer than it is remembered: two tracks, the second a short piece
                continue
            i = len(rows)
            stray = slot == 0 and frame == 30  # something else on the spot
            look = looks[7] if stray else looks[slot] + r.normal(0, 0.01, 8)
            x = 100 * slot + frame % 2
            rows.append((i, f"/s/{frame}.png", None if frame % 2 else "/v.mp4", frame if frame % 2 == 0 else None, float(x), 10.0, float(x + 60), 60.0, 0.5, "a" if slot < 3 else "b", None, look.tolist()))
            want[i] = None if stray else slot
    t = df(spark, rows, "roi_index int, image_path string, video_path string, frame_number int, x_min float, y_min float, x_max float, y_max float, confidence float, label string, new_label string, embedding array<float>")
    ranks = linking.frame_ranks(t)
    assert ranks.count() == 60 and sorted(x["frame"] for x in ranks.collect()) == list(range(1, 61))
    found = linking.fixtures(t, min_frames=15)
    groups = {}
    for x in found["fixtures"].collect():
        groups.setdefault(x["fixture"], set()).add(x["roi_index"])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i, s in want.items() if s == k) for k in range(4))
    got = found["coverage"].first().asDict()
    n = len(rows)
    assert got["boxes"] == n and got["kept"] == n - 1 and got["fixtures"] == 4 and got["intruders"] == 1 and got["split"] == 0 and got["percent"] == round(100 * (n - 1) / n, 1)
    info = {x["fixture"]: x for x in found["fixture_info"].collect()}
    assert all(info[f]["n"] == len(ids) for f, ids in groups.items())


def test_track_rows_by_preset(spark):
    obs = df(spark, [("/v.mp4", t, f, 1.0, 1.0, 5.0, 5.0, 0.1 * f, f % 2, 1.0) for t, n in ((1, 3), (2, 10)) for f in range(n)], "video_path string, track_id int, frame_number int, x_min double, y_min double, x_max double, y_max double, confidence double, class_id int, sharpness double")
    got = {r["track_id"]: r for r in detections.track_rows(obs, "best-conf", least=4).collect()}
    assert set(got) == {2} and got[2]["frame_number"] == 9 and got[2]["class_id"] == 1 and got[2]["track_length"] == 9


def test_clamps(spark):
    t = df(spark, [(9.5, 2.0, -3.0, 8.5)], "x_min double, y_min double, x_max double, y_max double")
    w, h = F.lit(10), F.lit(6)
    assert tuple(t.select(*boxes.clamp_import(boxes.sides(), w, h)).first()) == (0, 2, 10, 6)
    assert tuple(t.select(*boxes.clamp_edit([F.lit(50.0), F.lit(50.0), F.lit(50.0), F.lit(50.0)], w, h)).first()) == (9, 5, 10, 6)


def test_sharpness_of_flat_and_empty():
    assert pixels.sharpness_of(b"", 0, 0, 1) == 0.0 and pixels.sharpness_of(b"\x05" * 16, 4, 4, 1) == 0.0
    assert pixels.sharpness_of(bytes([0, 255] * 8), 4, 4, 1) > 1000


def test_fill_leaves_bad_items_null(spark):
    def scorer(pdf):
        return [[1.0 / (i - 2)] for i in pdf["id"]]

    t = df(spark, [(i, None) for i in range(4)], "id int, embedding array<float>")
    out, counts = vectors.fill(t, scorer, [])
    assert [r["embedding"] is None for r in out.orderBy("id").collect()] == [False, False, True, False]
    assert tuple(counts.first()) == (3, 1)


def test_similar_without_a_vector(spark):
    t = df(spark, [(1, None, "a", None, 0, 0.5)], "roi_index int, embedding array<float>, label string, new_label string, verified int, confidence float")
    assert vectors.similar(t, 1) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_cut_drops_shuffle_files(spark):
    def shuffles():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle_")}

    numbers = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    before, setting = shuffles(), spark.conf.get(SHUFFLE_CLEANUP)
    table = cut(numbers, "shuffled")
    assert not shuffles() - before and spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert table.agg(F.sum("n")).first()[0] == 5000 and numbers.count() == 100  # the frame itself can be run again


def test_crops_of_an_image_with_many_boxes_are_handed_on_in_pieces(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(pixels, "BOXES", 7)
    monkeypatch.setattr(pixels, "CROP_BYTES", 100)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20))
    px = (np.arange(48 * 64 * 3) % 251).astype(np.uint8).reshape(48, 64, 3)
    pictures = spark.createDataFrame([("/p.png", 64, 48, 3, px.tobytes())], "image_path string, width int, height int, channels int, data binary")
    i = F.col("roi_index")
    rows = spark.range(500).select(F.col("id").alias("roi_index"), F.lit("/p.png").alias("image_path")).select("*", (i % 50).alias("x_min"), (i % 40).alias("y_min"), (i % 50 + 3 + i % 20).alias("x_max"), (i % 40 + 2 + i % 11).alias("y_max"))
    got = {r["roi_index"]: (r["width"], r["height"], bytes(r["data"])) for r in pixels.crops(pictures, rows).collect()}
    assert len(got) == 500
    for k, (w, h, data) in got.items():
        part = px[k % 40 : k % 40 + 2 + k % 11, k % 50 : k % 50 + 3 + k % 20]
        assert (w, h, data) == (part.shape[1], part.shape[0], part.tobytes())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
