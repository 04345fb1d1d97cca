import pytest
from pyspark.sql import functions as F

from boxwright.operators import clustering, review, vectors
from boxwright.operators.ranking import Ranking, rows_of

DDL = "roi_index int, embedding array<float>, label string, new_label string, verified int, confidence float"


def pool(spark, vectors_, label="a"):
    return spark.createDataFrame([(i, v, label, None, 0, 0.5) for i, v in enumerate(vectors_)], DDL)


def test_pages_of_a_ranking(spark):
    df = spark.range(1000).select(F.col("id").cast("int").alias("roi_index"), (F.col("id") * 37 % 101).alias("score"))
    whole = [r["roi_index"] for r in df.orderBy(F.desc("score"), "roi_index").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    stored = Ranking(df, F.desc("score"), "roi_index")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert stored.size == 1000 and len(stored._before) > 1
    for offset, size in ((0, 25), (480, 40), (990, 25), (1000, 5), (0, 1000)):
        got = stored.page(offset, size).collect()
        assert [r["roi_index"] for r in got] == whole[offset : offset + size] and [r["rank"] for r in got] == list(range(offset + 1, min(1000, offset + size) + 1))
    assert [r["rank"] for r in stored.last(30).collect()] == list(range(991, 1001))
    table = df.withColumn("text", F.concat(F.lit("t"), "roi_index"))
    got = rows_of(stored.page(10, 5), table).collect()
    assert [r["text"] for r in got] == [f"t{i}" for i in whole[10:15]]
    plan = stored.page(10, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "_part" in plan and "rangepartitioning(score" not in plan.lower()
    empty = Ranking(df.limit(0), "roi_index")
    assert empty.size == 0 and empty.page(0, 5).count() == 0 and empty.last(5).count() == 0
    stored.drop()


def test_pools_without_rows_or_vectors(spark):
    some = pool(spark, [[1.0, 0.0], [0.0, 1.0], None])
    assert [r["roi_index"] for r in vectors.similar(some, 0).collect()] == [0, 1]
    assert vectors.similar(some, 0, label="nobody").count() == 0
    assert vectors.similar(some, 2) is None and vectors.similar(some, 99) is None
    assert vectors.similar(some, 0, ids=some.filter("roi_index = 1")).count() == 1
    none = pool(spark, [None, None])
    assert vectors.similar(none, 0) is None and [r["score"] for r in vectors.outliers(none).collect()] == [None, None]
    assert vectors.outliers(none.limit(0)).count() == 0 and vectors.mean_vector(none, "embedding").count() == 0
    got = vectors.outliers(some).collect()
    assert got[-1]["roi_index"] == 2 and got[-1]["score"] is None and got[0]["score"] is not None
    assert clustering.clusters(none) is None


def test_vectors_of_several_lengths_are_a_clear_error(spark):
    mixed = pool(spark, [[1.0, 0.0], [1.0, 0.0, 2.0]])
    for f in (lambda: vectors.similar(mixed, 0), lambda: vectors.outliers(mixed)):
        with pytest.raises(ValueError, match="2 to 3 numbers"):
            f()


def test_shares_hidden_by_confidence(spark):
    hidden = spark.createDataFrame([("a", 8, 3), ("b", 1, 0)], "label string, total bigint, hidden bigint")
    assert [tuple(r) for r in review.hidden_shares(hidden).orderBy("label").collect()] == [("a", 5, 37.5), ("b", 1, 0.0)]


def test_adhoc_statements(spark):
    t = spark.range(7)
    rows, more = review.adhoc(spark, "SELECT id, id AS id FROM t ORDER BY id", 5, t=t)
    assert [tuple(r) for r in rows.collect()] == [(i, i) for i in range(5)] and more == 2
    rows, more = review.adhoc(spark, "SELECT id FROM t WHERE id > 100", 5, t=t)
    assert rows.count() == 0 and more == 0 and rows.columns == ["id"]
