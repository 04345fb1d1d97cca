import os
from functools import partial

import pytest

import corpus_pipeline
from boxwright.llm import quality, queries
from boxwright.session import cut, saved, scratch_dir
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    lines = brute.removed_lines([(r[0], r[3], r[1]) for r in rows], quality.MIN_DOCS, quality.MAX_SHARE, quality.MAX_DOCS)
    good = [(r[0], left) for r, (ok, left, _) in zip(rows, lines, strict=True) if ok and not brute.quality(r[1])[-1]]
    one = {c for _, _, c in brute.components([(r[0], r[1]) for r in good])}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, SF), "stage")
        if k < 4:
            assert docs.columns == columns
        ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if k == 0:
            assert sorted(tuple(r) for r in docs.select("doc_id", "text").collect()) == sorted(good)
        if k == 1:
            assert ids == sorted(one)
            texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        if k == 2:
            bench = [tuple(r) for r in queries.table(spark, SF, "benchmark").collect()]
            hit = {d: n_hit / max(1, n) for d, n, n_hit, *_ in brute.contamination(texts, bench)}
            assert ids == sorted(d for d, share in hit.items() if share <= 0.5)
            assert any(share > 0 for share in hit.values())
    assert set(docs.columns) == {"doc_id", "n_tokens", "ids"}
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in docs.collect())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_stages_on_odd_and_empty_tables(spark):
    """Nulls in every column, empty texts, repeated rows: each stage keeps columns and types, and an empty table stays one."""
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = "A line of ten words and a few more, to be kept. Mail ann@example.org or 10.2.3.4 about it."
    rows = [(1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text + " Again and again, other words.", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, ddl)
    empty = spark.createDataFrame([], ddl)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        assert stage(spark, empty, SF).count() == 0
        docs = spark.createDataFrame(out.collect(), ddl)
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) <= {1, None} and all("ann@example.org" not in t and "10.2.3.4" not in t for t in got.values()) and docs.count() >= 1
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF).count() == docs.count() and last(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", ["op1_simhash", "op4_decontaminate", "op8_secrets", "op10_suffix_dedup", "op12_url_filter", "pipeline"])
def test_nothing_stays_in_the_shared_folder(spark, tmp_path, name):
    """A result written by ``saved`` leaves no scratch table behind, and is the one that the query gives."""
    make = partial(corpus_pipeline.run if name == "pipeline" else queries.queries()[name], spark, SF)
    root = scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = saved(spark, make, str(tmp_path / "out"))
    assert set(os.listdir(root)) == before and out.count() > 0
