import os

import pytest
from pyspark.sql import functions as F

from boxwright.session import cleared, cut, saved, scratch, scratch_dir, scratch_path


def there(spark):
    root = scratch_dir(spark).removeprefix("file://")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_scratch_tables_go_when_a_result_is_written(spark, tmp_path):
    before = there(spark)

    def make():
        one = cut(spark.range(100).withColumn("k", F.col("id") % 7), "one")
        with scratch(spark) as own:
            counts = cut(own(one.groupBy("k").count(), "own"), "counts")
        assert len(there(spark) - before) == 2
        return one.join(counts, "k")

    out = saved(spark, make, str(tmp_path / "out"))
    assert there(spark) == before and out.count() == 100 and out.columns == ["k", "id", "count"]


def test_nested_ones_remove_their_own_only(spark):
    before = there(spark)
    with cleared(spark):
        outer = cut(spark.range(10), "outer")
        path = scratch_path(spark, "inner-result")
        inner = saved(spark, lambda: cut(outer, "inner").withColumn("x", F.lit(1)), path)
        assert len(there(spark) - before) == 2 and inner.count() == outer.count() == 10
    assert there(spark) == before
    kept = cut(spark.range(3), "kept")
    assert len(there(spark) - before) == 1 and kept.count() == 3


def test_scratch_tables_go_when_the_work_fails(spark, tmp_path):
    before = there(spark)

    def make():
        cut(spark.range(10), "lost")
        raise ValueError("stopped")

    with pytest.raises(ValueError, match="stopped"):
        saved(spark, make, str(tmp_path / "never"))
    assert there(spark) == before and not (tmp_path / "never").exists()
