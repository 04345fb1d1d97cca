import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boxwright.components import connected_components
from boxwright.operators import linking
from boxwright.plans.fixture_views import view

DDL = "camera string, frame int, roi_index int, x_min float, y_min float, x_max float, y_max float"


def scene(seed, n_frames=120, width=900, spots=25, strays=6):
    """Boxes that stay, drift, vanish, overlap and cross, with strays, odd and empty ones."""
    r = np.random.default_rng(seed)
    place = np.c_[r.uniform(0, width, spots), r.uniform(0, width / 2, spots)]
    size = r.uniform(8, 130, (spots, 2))
    drift = r.normal(0, 0.8, (spots, 2)) * (r.random((spots, 1)) < 0.4)
    rows = []
    for frame in range(n_frames):
        for k in range(spots):
            if r.random() < 0.8:
                (x, y), (w, h) = place[k] + drift[k] * frame + r.normal(0, 1.5, 2), size[k] * r.uniform(0.85, 1.15, 2)
                rows.append((x, y, x + w, y + h, frame))
        for _ in range(strays):
            x, y, w, h = r.uniform(0, width), r.uniform(0, width / 2), *r.uniform(0, 200, 2)
            rows.append((x, y, x + w, y + h, frame))
    rows += [(5.0, 5.0, 5.0, 9.0, 3), (9.0, 9.0, 4.0, 4.0, 3), (None, 1.0, 2.0, 2.0, 4), (float("nan"), 1.0, 2.0, 2.0, 4), (None, None, None, None, 4)]
    order = r.permutation(len(rows))
    cameras = ["c", None, "d"]
    return [(cameras[i % 3], frame, int(order[i]), *(None if v is None else float(v) for v in box)) for i, (*box, frame) in enumerate(rows)]


def tracks(df):
    return sorted((r["camera"] or "", r["roi_index"], r["track"]) for r in df.collect())


@pytest.mark.parametrize(("seed", "iou", "retire"), [(0, 0.5, 24), (1, 0.5, 2), (2, 0.3, 24), (3, 0.8, 5)])
def test_zones_give_the_tracks_of_one_task(spark, seed, iou, retire):
    rows = spark.createDataFrame(scene(seed), DDL).repartition(3)
    assert tracks(linking.link(rows, iou, retire=retire)) == tracks(linking.link(rows, iou, retire=retire, by_zone=False))


def test_zones_of_the_given_boxes(spark):
    rows = view(spark, "/root/testdata/sf0.001", "linked_boxes").withColumn("camera", F.lit("one"))
    assert tracks(linking.link(rows)) == tracks(linking.link(rows, by_zone=False))
    zones = linking.zones(rows)
    assert zones.count() == rows.count() and zones.select("zone").distinct().count() > 5  # several tasks for one camera
    wide = rows.unionByName(rows.limit(1).withColumns({"roi_index": F.lit(10**6), "x_max": F.lit(1e7).cast("float")}))
    assert tracks(linking.link(wide)) == tracks(linking.link(wide, by_zone=False))


def test_zones_of_nothing_and_without_a_least_overlap(spark):
    none = spark.createDataFrame([], DDL)
    assert linking.link(none).count() == 0
    rows = spark.createDataFrame(scene(5, 10), DDL)
    assert tracks(linking.link(rows, 0.0)) == tracks(linking.link(rows, 0.0, by_zone=False))


def test_few_and_many_candidates_are_linked_alike(monkeypatch):
    pdf = pd.DataFrame(scene(7, 60, 300), columns=[f.split(" ")[0] for f in DDL.split(", ")]).astype({s: "float64" for s in ("x_min", "y_min", "x_max", "y_max")})
    got = []
    for few in (0, 10**9):
        monkeypatch.setattr(linking, "FEW", few)
        got.append(linking._link_frames(pdf, 0.5, 0.3, 24).sort_values("roi_index")["track"].tolist())
    assert got[0] == got[1] and len(set(got[0])) < len(got[0])


def test_components_in_one_task_and_in_rounds(spark):
    r = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in r.integers(-200, 200, (230, 2))]
    links = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(4)
    show = lambda few: sorted(tuple(x) for x in connected_components(links, few=few).collect())
    assert show(0) == show(10**6) and len(show(0)) > 100
    assert connected_components(links.limit(0), few=5).count() == 0


def survey(spark, cameras):
    r = np.random.default_rng(1)
    looks, rows = np.eye(8), []
    for frame in range(60):
        for slot in range(3):
            i, x = len(rows), 100 * slot + frame % 2
            look = looks[slot] + r.normal(0, 0.01, 8)
            rows.append((i, f"/s/{frame}.png", cameras[slot % len(cameras)], None, float(x), 10.0, float(x + 60), 60.0, 0.5, "a", None, look.tolist()))
    return spark.createDataFrame(rows, "roi_index int, image_path string, video_path string, frame_number int, x_min float, y_min float, x_max float, y_max float, confidence float, label string, new_label string, embedding array<float>")


def test_boxes_without_a_camera_are_kept(spark):
    df = survey(spark, [None, "/v.mp4", None])
    found = linking.fixtures(df, "video_path", min_frames=15)
    got = found["coverage"].first()
    assert got["boxes"] == 180 and got["kept"] == 180 and got["fixtures"] == 3
    assert {r["camera"] for r in found["rows"].select("camera").distinct().collect()} == {None, "/v.mp4"}
    ranks = linking.frame_ranks(df, "video_path")
    assert ranks.filter("camera is null").agg(F.max("frame")).first()[0] == 60


def test_linking_without_vectors(spark):
    df = survey(spark, ["c"]).withColumn("embedding", F.lit(None).cast("array<float>"))
    found = linking.fixtures(df, min_frames=15)
    assert tuple(found["coverage"].first())[:3] == (3, 180, 180) and found["fixture_info"].count() == 3
    assert linking.fixtures(df.limit(0))["fixtures"].count() == 0


def test_tracks_are_linked_once(spark, monkeypatch):
    groups, kernel = spark.sparkContext.accumulator(0), linking._link_frames
    rows = view(spark, "/root/testdata/sf0.001", "linked_boxes")
    zones = linking.zones(rows.select("camera", "frame", "roi_index", *(F.col(s).cast("double") for s in ("x_min", "y_min", "x_max", "y_max")))).select("camera", "zone").distinct().count()

    def counted(pdf, *args):
        groups.add(1)
        return kernel(pdf, *args)

    monkeypatch.setattr(linking, "_link_frames", counted)
    found = linking.kept(rows.join(linking.link(rows), ["camera", "roi_index"]), 2)
    assert linking.fixture_info(found.withColumns({"typicality": F.lit(None).cast("double"), "image_path": F.col("frame")})).count() > 0
    assert groups.value == zones


def _pairs(*rows):
    return pd.DataFrame(rows, columns=["camera", "a", "b", "n_a", "n_b", "cosine"])


def bitmaps(seen):
    """Rows of frame_bitmaps for sets of frames."""
    out = []
    for t, frames in seen.items():
        blocks = {}
        for f in frames:
            blocks[1 + (f - 1) // 32768] = blocks.get(1 + (f - 1) // 32768, 0) | 1 << (f - 1) % 32768
        out += [("c", t, k, v.to_bytes(4096, "little")) for k, v in blocks.items()]
    return pd.DataFrame(out, columns=["camera", "track", "block", "bits"])


def test_merge_takes_the_most_alike_first_and_small_pieces_by_number():
    seen = {"2": range(1, 51), "10": range(51, 91), "3": range(41, 61), "11": range(201, 206), "4": range(206, 209), "1/b": range(301, 401)}
    pairs = _pairs(("c", "10", "2", 40, 50, 0.95), ("c", "2", "3", 50, 20, 0.99), ("c", "10", "3", 40, 20, 0.97), ("c", "11", "2", 5, 50, 0.91), ("c", "11", "10", 5, 40, 0.93), ("c", "2", "4", 50, 3, 0.92), ("c", "11", "4", 5, 3, 0.99), ("c", "1/b", "10", 100, 40, 0.9))
    got = {r.track: r.into for r in linking._merge(pairs, bitmaps(seen), 20, 0.05).itertuples()}
    # 2 and 3 share ten frames, as do 10 and 3; 2 and 10 join, then all go to the larger 1/b; pieces join what 10 and 2 are part of.
    assert got == {"2": "1/b", "10": "1/b", "11": "1/b", "4": "1/b"}


def test_merging_by_components_is_merging_by_camera(spark):
    r = np.random.default_rng(3)
    rows, units = [], []
    for t in range(60):
        spot, n = t % 12, int(r.integers(3, 60))
        frames = r.choice(np.arange(1, 70_000, 97), n, replace=False)
        for f in frames:
            i = len(rows)
            rows.append(("c" if spot % 2 else "d", int(f), i, str(t), 100.0 * spot, 5.0, 100.0 * spot + 60, 60.0))
            units.append((i, (np.eye(12)[spot] + r.normal(0, 0.05, 12)).tolist()))
    df = spark.createDataFrame(rows, "camera string, frame int, roi_index int, track string, x_min float, y_min float, x_max float, y_max float")
    u = spark.createDataFrame(units, "roi_index int, u array<double>")
    got = {x["track"]: x["into"] for x in linking.merge_fragments(df, u).collect()}
    frames = {}
    for _, f, _, t, *_ in rows:
        frames.setdefault(t, set()).add(f)
    assert {x["track"]: x["n"] for x in linking.frame_bitmaps(df).groupBy("track").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()} == {t: len(s) for t, s in frames.items()}
    mean = {t: np.mean([units[i][1] for _, _, i, tt, *_ in rows if tt == t], axis=0) for t in frames}
    cosine = lambda a, b: float(mean[a] @ mean[b] / np.linalg.norm(mean[a]) / np.linalg.norm(mean[b]))
    pairs = [("c", a, b, len(frames[a]), len(frames[b]), cosine(a, b)) for a in frames for b in frames if a < b and int(a) % 12 == int(b) % 12 and cosine(a, b) >= 0.9]
    expected = {x.track: x.into for x in linking._merge(_pairs(*pairs), bitmaps(frames), 20, 0.05).itertuples()}
    assert got == expected and len(got) > 10


def test_tables_of_a_row_a_box_are_not_sent_to_every_task(spark):
    """Equal vectors take next to no bytes in a file, so their size there says nothing of their rows."""
    from boxwright.session import cut

    ids = spark.range(2000).select(F.col("id").cast("int").alias("roi_index"))
    units = cut(ids.withColumn("u", F.array(*(F.lit(0.125) for _ in range(64)))), "units")
    tracks = cut(ids.select("roi_index", F.lit("c").alias("camera"), (F.col("roi_index") % 7).cast("string").alias("track")), "tracks")
    names = cut(ids.withColumn("lab", F.lit("crab")), "names")
    for out in (linking.typicality(tracks, units), linking.split_labels(tracks, names, units)):
        joins = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin [roi_index" in x]
        assert not joins
    assert linking.typicality(tracks, units).filter("abs(typicality - 1) < 1e-9").count() == 2000


def test_merging_reads_pairs_in_order_and_holds_frames_only():
    """Equal to the merge of whole tables, batch by batch, part after part."""
    import pyarrow as pa

    seen = {"2": range(1, 51), "10": range(51, 91), "3": range(41, 61), "11": range(201, 206), "4": range(206, 209), "1/b": range(301, 401)}
    rows = []
    for part in (5, 6):
        rows += [(part, 0, "c", r.track, None, r.block, r.bits) for r in bitmaps(seen).itertuples()]
        rows += [(part, 1, "c", a, b, None, None) for a, b in (("2", "3"), ("3", "10"), ("2", "10"), ("10", "1/b"))]
        rows += [(part, 2, "c", a, b, None, None) for a, b in (("4", "2"), ("11", "10"), ("11", "2"))]
    schema = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("camera", pa.string()), ("a", pa.string()), ("b", pa.string()), ("block", pa.int64()), ("bits", pa.binary())])
    table = pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    got = [x for b in linking._merge_rows(20, 0.05)(iter(table.to_batches(max_chunksize=3))) for x in b.to_pylist()]
    assert len(got) == 8 and {x["track"]: x["into"] for x in got} == {"2": "1/b", "10": "1/b", "11": "1/b", "4": "1/b"}


def test_order_of_tracks_as_a_column(spark):
    tracks = ["10", "9", "x", "0/a", "2/b/c", "10/a", "/z", "y/", "2/b", "99999999999999999"]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in tracks], "t string").orderBy(linking._order(F.col("t"))).collect()]
    assert [linking._number(t) for t in got] == sorted(map(linking._number, tracks))


@pytest.mark.parametrize("shared", [0, 3])
def test_merging_by_blocks_leaves_forests_and_merges_as_all_pairs_do(spark, monkeypatch, shared):
    """Small blocks of tracks in spots on the borders of cells; ``shared``: spots up to there have tracks in the same frames."""
    monkeypatch.setattr(linking, "PART_TRACKS", 40)
    r = np.random.default_rng(11)
    rows, units, frames = [], [], {}
    for spot in range(6):
        free = r.permutation(4000)[:2600]
        for k in range(40):
            n = int(r.integers(3, 60))
            mine, free = (free[:n], free[n:]) if spot >= shared else (r.choice(np.arange(1, 400), n, replace=False), free)
            t = str(spot * 40 + k)
            frames[t] = set((mine + 1).tolist())
            look = np.eye(6)[spot] + r.normal(0, 0.12, 6)
            for f in frames[t]:
                i, x = len(rows), 80.0 * spot + 230 + k % 3
                rows.append(("c", int(f), i, t, x, 240.0, x + 60, 290.0))
                units.append((i, look.tolist()))
    df = spark.createDataFrame(rows, "camera string, frame int, roi_index int, track string, x_min float, y_min float, x_max float, y_max float")
    u = spark.createDataFrame(units, "roi_index int, u array<double>")
    made = []
    plain = linking._like_pairs

    def seen(*args, every):
        out = plain(*args, every=every).cache()
        made.append((every, out.count()))
        return out

    monkeypatch.setattr(linking, "_like_pairs", seen)
    got = {x["track"]: x["into"] for x in linking.merge_fragments(df, u).collect()}
    look = {t: np.array(units[i][1]) for i, (_, _, _, t, *_) in enumerate(rows)}
    cosine = lambda a, b: round(float(look[a] @ look[b] / np.linalg.norm(look[a]) / np.linalg.norm(look[b])), 12)
    pairs = [("c", a, b, len(frames[a]), len(frames[b]), cosine(a, b)) for a in frames for b in frames if a < b and int(a) // 40 == int(b) // 40 and cosine(a, b) >= 0.9]
    expected = {x.track: x.into for x in linking._merge(_pairs(*pairs), bitmaps(frames), 20, 0.05).itertuples()}
    assert got == expected and len(got) > 60
    big = [p for p in pairs if max(p[3:5]) >= 20]
    assert [e for e, _ in made] == [False, True][: 1 + bool(shared)] and made[0][1] < 0.6 * len(big)
    assert not shared or made[1][1] == sum(int(p[1]) // 40 < shared for p in big)


def test_vectors_stay_where_they_are_and_passers_by_are_no_pairs(spark):
    """Typicality without another shuffle of vectors; small tracks of one spot are not paired with each other."""
    r = np.random.default_rng(4)
    u = r.normal(size=(600, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rows = [(i, "c", str(i % 40 if i < 400 else i), None if i % 9 == 0 else [0.0, 0.0, 0.0] if i == 401 else u[i].tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "roi_index int, camera string, track string, u array<double>")
    out = linking._with_typicality(df)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    got = {x["roi_index"]: x["typicality"] for x in out.collect()}
    want = {x["roi_index"]: x["typicality"] for x in linking.typicality(df.drop("u"), df.filter("u is not null").select("roi_index", "u")).collect()}
    assert len(got) == 600 and {i for i, t in got.items() if t is None} == {i for i in range(600) if i % 9 == 0}
    assert all(abs(got[i] - t) < 1e-9 for i, t in want.items()) and got[401] == 0
    tracks = spark.range(3000).selectExpr("id nth", "'c' camera", "cast(id as string) track", "if(id < 2, 30L, 1L) n", "10.0D + 400 * int(id > 1) x_min", "10.0D y_min", "60.0D + 400 * int(id > 1) x_max", "50.0D y_max")
    means = tracks.selectExpr("camera", "track", "array(1.0D, 2.0D) mean")
    assert [tuple(x) for x in linking._like_pairs(tracks, means, 0.9, 20, every=True).select("a", "b", "kind").collect()] == [(0, 1, 0)]
