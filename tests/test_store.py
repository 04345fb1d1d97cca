import os
import threading

import pytest
from pyspark.sql import functions as F

from boxwright import schema
from boxwright.functions import labels
from boxwright.operators import mutations, review, vectors
from boxwright.plans import chain
from boxwright.session import scratch_path
from boxwright.store import Conflict, Layout, Store
from boxwright.streaming.ingest import incremental

COLS = "id int, roi_index int, image_path string, label string, new_label string, verified int, embedding array<float>, roi binary"


def table(spark, n, start=0):
    i = F.col("id")
    image = F.format_string("/s/%05d.png", (i * 7 % max(1, n // 8)).cast("int"))
    return spark.range(start, start + n).select(i.cast("int").alias("id"), i.cast("int").alias("roi_index"), image.alias("image_path"), F.lit("a").alias("label"), F.lit(None).cast("string").alias("new_label"), F.lit(0).alias("verified"), F.array(*(i.cast("float") + k for k in range(16))).alias("embedding"), F.lit(b"xx").alias("roi"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture
def store(spark):
    return Store(spark, scratch_path(spark, "store"))


def test_versions_and_batches(spark, store):
    with pytest.raises(FileNotFoundError):
        store.read("t")
    store.write(t=spark.range(3), u=spark.range(1))
    store.write(t=store.read("t").filter("id > 0"))
    assert store.read("t").count() == 2 and store.read("u").count() == 1 and store.versions() == {"t": 1, "u": 0}
    store.append("t", spark.range(3, 5), 0)
    store.append("t", spark.range(900, 910), 0)  # there already
    store.append("t", spark.range(5, 6), 1)
    store.append("t", spark.range(7, 9), 0, "another writer")
    assert ids(store.read("t")) == [1, 2, 3, 4, 5, 7, 8] and store.has_batch("t", 1) and not store.has_batch("t", 2) and not store.has_batch("t", 1, "another writer")
    store.write(t=store.read("t").filter("id > 3"))
    assert store.has_batch("t", 1) and store.has_batch("t", 0, "another writer")
    store.append("t", spark.range(900, 910), 1)  # still there already
    assert ids(store.read("t")) == [4, 5, 7, 8] and ids(store.read("t", version=0)) == [0, 1, 2]


@pytest.mark.parametrize("step", ["data", "part", "name"])
def test_a_crash_at_any_step_leaves_the_last_whole_state(spark, store, monkeypatch, step):
    store.write(t=spark.range(3), predictions=table(spark, 20))
    with monkeypatch.context() as m:

        def broken(*_, **__):
            raise OSError("gone")

        m.setattr(Store, {"data": "_write", "part": "_publish", "name": "_name"}[step], broken)
        for change in (lambda: store.write(t=spark.range(50)), lambda: store.append("t", spark.range(50), 0), lambda: store.append("predictions", table(spark, 5, 20), 0)):
            with pytest.raises(OSError):
                change()
    again = Store(spark, store.root)
    assert again.read("t").count() == 3 and again.read("predictions").count() == 20 and not again.has_batch("t", 0)
    again.append("t", spark.range(3, 5), 0)
    again.append("t", spark.range(3, 5), 0)
    assert ids(again.read("t")) == [0, 1, 2, 3, 4]
    assert not [n for n in os.listdir(f"{store.root.removeprefix('file://')}/_log") if n.endswith(".part")]


def test_a_taken_number_is_refused_by_links_and_by_renames(spark, store, monkeypatch):
    store.write(t=spark.range(1))
    assert not store._publish(0, {}) and store._publish(1, store._state()[1])

    class Remote:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def getUri(self):  # noqa: N802
            return type("Uri", (), {"getScheme": staticmethod(lambda: "hdfs")})

    whole = Store._path
    monkeypatch.setattr(Store, "_path", lambda self, path: (whole(self, path)[0], Remote(whole(self, path)[1])))
    assert not store._publish(1, {}) and store._publish(2, store._state()[1]) and store.log() == [0, 1, 2]


def test_two_writers_never_lose_a_change(spark, store):
    store.write(predictions=table(spark, 40))
    new = spark.createDataFrame([("/n.png", "x")], "image_path string, label string")
    errors = []

    def work(k):
        try:
            own = Store(spark, store.root)
            for j in range(2):
                own.append("predictions", lambda now: mutations.next_rows(now, new, ["image_path"]), j, f"w{k}")
                own.change("predictions", spark.createDataFrame([(10 * k + j, f"w{k}")], "id int, new_label string"))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = store.read("predictions").collect()
    assert not errors, str(errors[0])
    assert sorted(r["id"] for r in got) == list(range(44))
    assert {r["id"]: r["new_label"] for r in got if r["new_label"]} == {10 * k + j: f"w{k}" for k in range(2) for j in range(2)}


def test_what_was_read_and_has_changed_is_a_conflict(spark, store):
    store.write(t=spark.range(3))
    other = Store(spark, store.root)
    mine = store.read("t").filter("id > 0")
    other.append("t", spark.range(10, 12))
    with pytest.raises(Conflict):
        store.write(t=mine)
    assert ids(store.read("t")) == [0, 1, 2, 10, 11]
    store.write(t=store.read("t").filter("id > 1"))
    assert ids(store.read("t")) == [2, 10, 11]


def test_changes_are_read_as_the_rewritten_table(spark, store):
    df = table(spark, 200)
    store.write(predictions=df)
    expected = df
    some = lambda k: df.filter(F.col("id") % k == 0).select("id")
    steps = [
        ("change", some(3).select("id", F.lit("crab").alias("new_label"), F.lit(1).alias("verified"))),
        ("change", some(5).select("id", F.lit(None).cast("string").alias("new_label"))),
        ("change", some(7).select("id", F.array(F.lit(1.0)).alias("embedding"), F.lit(2).alias("verified"))),
        ("delete", some(11)),
        ("change", some(2).select("id", F.lit("x").alias("label"))),
    ]
    for kind, rows in steps:
        if kind == "change":
            store.change("predictions", rows)
            expected = mutations.bulk_update(expected, rows, "id")
        else:
            store.delete("predictions", rows)
            expected = expected.join(rows, "id", "left_anti")
    more = table(spark, 30, 195).filter("id >= 198")  # 198 was deleted: its number is used again
    expected = expected.filter("id < 198 or id = 199").union(more.filter("id <> 199").select(*expected.columns))
    store.append("predictions", more.filter("id <> 199"))
    show = lambda x: sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in x.select(*df.columns).collect()), key=repr)
    assert show(store.full("predictions")) == show(expected)
    store.compact("predictions")
    assert show(store.full("predictions")) == show(expected) and not store._state()[1]["predictions"]["deltas"]
    with pytest.raises(ValueError, match="nope"):
        store.change("predictions", some(3).withColumn("nope", F.lit(1)))


def size_of(path):
    return sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(path.removeprefix("file://")) for n in names if n.endswith(".parquet"))


def test_label_changes_write_in_proportion_to_their_rows(spark, store):
    store.write(predictions=table(spark, 60_000))
    before = size_of(store.root)
    for k in range(15):
        store.change("predictions", spark.range(k * 1000, k * 1000 + 1000).select(F.col("id").cast("int").alias("id"), F.lit(f"l{k}").alias("new_label"), F.lit(1).alias("verified")).coalesce(1))
    assert size_of(store.root) - before < before / 4
    assert store.read("predictions").filter("verified = 1").count() == 15_000
    narrow = store.read("predictions").agg(F.count_if(F.col("new_label").startswith("l")).alias("n"), F.count_distinct("new_label").alias("labels")).first()
    assert tuple(narrow) == (15_000, 15)


def scans(df):
    """Folders that a plan reads."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_never_open_vectors_and_groups_join_without_a_shuffle(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.write(predictions=table(spark, 3000))
        counts = review.label_counts(store.read("predictions"), require_verified=False)
        changed = mutations.apply_label(store.read("predictions"), spark.range(5).select(F.col("id").cast("int").alias("roi_index")), "x")
        for df in (counts, changed):
            files = {f.split("/predictions/")[1].split("/")[0] for f in df.inputFiles() if "/predictions/" in f}
            assert files == {"main"}
        plan = scans(store.full("predictions"))
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        store.change("predictions", store.read("predictions").filter("id % 3 = 0").select("id", F.lit("y").alias("new_label")))
        store.append("predictions", table(spark, 100, 3000))
        store.compact("predictions")
        assert "Exchange" not in scans(store.full("predictions")) and store.full("predictions").count() == 3100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_scanned(df):
    """Rows that the Parquet scans of a query hand on, after row groups and pages are left out."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        for name in ("executedPlan", "plan"):
            if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec"):
                inner = node.executedPlan() if "Adaptive" in node.getClass().getSimpleName() else node.plan()
                todo.append(inner)
                break
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_point_reads_do_not_grow_with_the_table(spark):
    """The table grows eightfold; an image, and a list of boxes, still read a few pages."""
    seen = {}
    layouts = {"predictions": Layout("id", {"vectors": ("embedding",), "roi": ("roi",)}, ("image_path", "id"), ("image_path", "roi_index"), 4)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (40_000, 320_000):
            store = Store(spark, scratch_path(spark, "store"), layouts)
            i = F.col("id")
            rows = spark.range(n).select(i.cast("int").alias("id"), i.cast("int").alias("roi_index"), F.format_string("/s/%07d.png", F.floor(i / 8).cast("int")).alias("image_path"), F.lit("a").alias("label"))
            store.write(predictions=rows)
            image = review.rois_for_image(store.read("predictions"), "/s/0000100.png")
            assert ids(image) == list(range(800, 808))
            one = store.read("predictions").filter("roi_index IN (5, 777, 12345)")
            assert ids(one) == [5, 777, 12345]
            seen[n] = rows_scanned(image), store.read("predictions").filter("id = 777").count()
        assert seen[320_000][0] <= 1.5 * max(seen[40_000][0], 1) + 80_000 and seen[320_000][0] < 320_000 / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_vacuum(spark, store):
    for k in range(4):
        store.write(t=spark.range(k + 1))
    root = store.root.removeprefix("file://")
    assert len(os.listdir(f"{root}/t/main")) == 4 and store.vacuum(keep=1) == 0  # young folders may be another writer's
    assert store.vacuum(keep=1, older_than=0) == 3 and store.read("t").count() == 4 and store.log() == [3]
    store.write(predictions=table(spark, 10))
    store.change("predictions", spark.createDataFrame([(1, "x")], "id int, label string"))
    store.compact("predictions")
    assert store.vacuum(keep=1, older_than=0) == 2 and store.full("predictions").filter("label = 'x'").count() == 1


def test_two_streams_into_one_table_and_a_replay_after_a_rewrite(spark, store):
    cols = "id int, roi_index int, image_path string, label string"
    store.write(predictions=spark.createDataFrame([], cols))
    root = scratch_path(spark, "stream")
    for k, n in (("a", 5), ("b", 7)):
        spark.createDataFrame([(None, None, f"/{k}{i}.png", k) for i in range(n)], cols).coalesce(1).write.parquet(f"{root}/{k}")
        incremental(spark, f"{root}/{k}", cols, store, f"{root}/check-{k}", ["image_path"])
    assert ids(store.read("predictions")) == list(range(12))
    store.write(predictions=store.read("predictions").withColumn("label", F.lit("changed")))
    log = root.removeprefix("file://") + "/check-a/commits"
    for n in os.listdir(log):  # as after a crash between the append and the stream's own commit
        os.remove(f"{log}/{n}")
    incremental(spark, f"{root}/a", cols, store, f"{root}/check-a", ["image_path"])
    assert ids(store.read("predictions")) == list(range(12)) and store.read("predictions").filter("label = 'changed'").count() == 12


def test_open_and_probes(spark, store, tmp_path):
    with pytest.raises(FileNotFoundError, match="no detection table"):
        schema.open_table(spark, str(tmp_path / "none"))
    spark.createDataFrame([(1, "a")], "id int, label string").write.parquet(str(tmp_path / "old"))
    old = schema.open_table(spark, str(tmp_path / "old"))
    assert old.first()["verified"] == 0 and schema.has_column(old, "track_id") and not schema.has_column(old, "nope")
    store.write(fixtures=spark.range(1))
    assert not schema.has_fixtures(store)
    store.write(fixture_info=spark.range(1))
    assert schema.has_fixtures(store)


def test_filling_scores_each_row_once_and_goes_on_where_it_stopped(spark, store):
    calls = spark.sparkContext.accumulator(0)

    def scorer(pdf):
        calls.add(len(pdf))
        if len(pdf) > 1 and (pdf["id"] == 77).any():
            raise ValueError("a batch with a bad item")
        return [[float(i)] if i != 77 else 1 / 0 for i in pdf["id"]]

    df = table(spark, 200).withColumn("embedding", F.when(F.col("id") < 10, F.array(F.lit(5.0).cast("float"))))
    out, counts = vectors.fill(df.filter("id <> 77"), scorer, [])
    assert out.filter("embedding is null").count() == 0 and tuple(counts.first()) == (189, 0) and calls.value == 189
    store.write(predictions=df)

    class Stop(Exception):
        pass

    left, change = [2], store.change

    def stops(*args):
        left[0] -= 1
        if left[0] < 0:
            raise Stop
        return change(*args)

    store.change = stops
    with pytest.raises(Stop):
        vectors.fill_store(store, scorer, [], batch=50)
    store.change = change
    have = store.read("predictions", "vectors").filter("embedding is not null").count()
    assert have == 99  # ids below 100, but for 77
    before = calls.value
    assert vectors.fill_store(store, scorer, [], batch=50) == (100, 1)
    assert store.full("predictions").filter("embedding is null").count() == 1 and calls.value - before <= 102
    main = [d for d in os.listdir(f"{store.root.removeprefix('file://')}/predictions/main")]
    assert len(main) == 1  # labels and boxes were not written again


def test_the_chain_exports_verified_rows_and_no_noise(spark, store):
    rows = [(i, i, f"/d/{i}.png", f"{i}.png", 0.0, 0.0, 5.0, 5.0, "a", "noise" if i % 3 == 0 else None, 1 if i % 2 else 0, 0.5, None) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, roi_index int, image_path string, image_name string, x_min float, y_min float, x_max float, y_max float, label string, new_label string, verified int, confidence float, embedding array<float>")
    sizes = df.select("image_path", F.lit(9).alias("width"), F.lit(9).alias("height"))
    out = chain.run(store, df, lambda pdf: [[1.0]] * len(pdf), [], sizes, last="embed")
    out = chain.run(store, None, None, [], sizes, first="export")
    assert sorted(r["path"] for r in out["voc"].collect()) == sorted(f"{i}.xml" for i in range(12) if i % 2 and i % 3)
    assert sum(r["content"].count("<figure") for r in out["html"].collect()) == 6
    store.change("predictions", store.read("predictions").select("id", F.lit(0).alias("verified")))
    out = chain.run(store, None, None, [], sizes, first="export")
    assert out["voc"].count() == 0 and out["html"].count() == 0
    assert store.read("predictions").filter(labels.verified()).count() == 0
