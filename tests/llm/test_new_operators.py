import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.llm import centroids, prefix_trie, queries, url_filter
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_repr(rows):
    return sorted((tuple(r) for r in rows), key=repr)


TURNS = "conv_id bigint, turn bigint, role string, text string, head string, path int, n int, whole string"


def conversations(seed, n):
    """Shared beginnings, exact copies, long ones, nulls, ties of turns and repeated rows."""
    r = random.Random(seed)
    say = [("user", "hi"), ("assistant", ""), (None, "ünï"), ("user", None), ("system", "x" * 50), ("user", "aa"), ("usera", "a")]
    rows = []
    for c in range(n):
        length = r.choice([1, 2, 3, 8, 9, 12])
        rows += [(c, t, *(say[0] if t < r.choice([0, 4, 9]) else r.choice(say))) for t in range(length)]
    rows += [(c, t, "user", "copy") for c in range(n, n + 40) for t in range(12)]
    rows += [(500, t, "user", str(t)) for t in range(300)] + [(505, t, "user", str(t) if t < 250 else "z") for t in range(300)]
    rows += [(-3, 0, "a", "b"), (-7, 1, "a", "c"), (None, 0, "user", "nobody"), (1003, None, "user", "first"), (1003, 0, "user", "second"), (1003, 0, "user", "tie"), (1003, 0, "user", "tie")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("holds", [0, 4096])
def test_prefix_trie(spark, holds):
    rows = conversations(holds, 60)
    df = spark.createDataFrame([(*x, "h", 1, 2, "w") for x in rows], TURNS).repartition(3)
    assert as_set(prefix_trie.trie(df, holds)) == by_repr(brute.trie(rows))


def test_prefix_trie_of_nothing_and_of_empty_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(1, 0, "user", "short"), (2, 0, "user", "short"), (3, 0, None, None)]  # no base: turns after the first h only
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert as_set(prefix_trie.trie(df)) == by_repr(brute.trie(rows))


def test_ids_of_a_path_are_hashed_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ids = [*range(-30, 50), 10**12]
    rebuilt = spark.createDataFrame([(i, bytearray(b"p" * 20)) for i in ids] + [(200, bytearray(b"q" * 20))], "conv_id bigint, path binary").repartition(5)
    got = {bytes(r["path"])[:1]: (r["n"], r["least"], r["ends"]) for r in prefix_trie.sequences(rebuilt).collect()}
    assert got[b"p"] == (81, -30, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) and got[b"q"][:2] == (1, 200)


def test_prefix_trie_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert as_set(queries.op11_prefix_trie(spark, SMALL)) == by_repr(brute.trie(rows))


URLS = ["http://a.com/x", "https://WWW.Example.com/en/1?q#f", "x://example.com/en/", "x://deep.www.example.com/en/2", "x://a.net/es/3", "x://net/fr/", "x://.net/fr/", "x://a.net/f", "x://a.net", "x://a.net?/fr/", "x://a.org/k/1#x", "x://b.a.org/k/12/y", "x://a.org/K/1", "x://notexample.com/en/", "no address", "", None, "://", "a://b://c/d", "x://h\nost/p\nath", "x://" + "l." * 3000 + "net/es/", "x://a.net/es/" + "p" * 100_000, "x://com", "x://com/", "x://u@a.com:80/en"]


@pytest.mark.parametrize("how", [{}, {"first_bits": 2, "later_bits": 1, "shard_bits": 400}])
def test_url_filter(spark, how):
    r = random.Random(1)
    listed = [("a.org", "/k/1"), ("org", f"/{7}"), ("b.c.org", ""), ("a.org", "/k/1"), ("never.org", "/")] + [(f"h{i}.org", f"/p{i}/") for i in range(60)]
    urls = URLS + [f"https://s{r.randrange(4)}.h{r.randrange(200)}.org/p{r.randrange(200)}/{i}" for i in range(300)] + [f"http://h{i}.org/p{i}/" for i in range(0, 60, 7)]
    rows = spark.createDataFrame([(i, u, "old", "html.x") for i, u in enumerate(urls)] + [(0, urls[0], "old", "html.x")], "page_id bigint, url string, verdict string, `ht.ml` string").repartition(3)
    rules = spark.createDataFrame(queries.URL_RULES + [(None, "/", "block")], "host string, path string, verdict string")
    out = url_filter.judged(rows, rules, spark.createDataFrame(listed + [(None, None)], "host string, path string"), **how)
    assert out.columns == ["page_id", "url", "ht.ml", "host", "path", "rule", "verdict"]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect())
    assert [(x[0], x[1], x[2], x[3], x[4]) for x in got] == sorted((i, *brute.url_verdict(u, queries.URL_RULES, listed)) for i, u in [*enumerate(urls), (0, urls[0])])


def test_url_filter_of_nothing(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "x://a.com/b")], "page_id bigint, url string")
    assert [tuple(r)[2:] for r in url_filter.judged(pages, rules, rules, default="block").collect()] == [("a.com", "/b", None, "block")]
    assert url_filter.judged(pages.limit(0), rules, rules).count() == 0


def test_cascade_has_several_levels_and_never_errs(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 9000, 3).select(F.concat(F.lit("k"), "id").alias("key"))
    found = url_filter.cascade(universe, listed, first_bits=2, later_bits=2)
    assert len(found.shards) == 1 and len(found.shards[0]) > 3
    rows = universe.select(F.array("key", F.lit("k3"), F.lit("k4")).alias("keys"))
    got = found.among(rows, "keys", "hits").collect()
    assert all(r["hits"] == [k for k in r["keys"] if int(k[1:]) % 3 == 0] for r in got) and len(got) == 4000


VECTORS = "vec_id bigint, embedding array<float>, label int, v string, cluster string"


def vectors(seed, n, dims=64, spread=0.3):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 1, (6, dims))
    x = (middle[r.integers(0, 6, n)] + r.normal(0, spread, (n, dims))).astype(np.float32)
    x[: n // 3] = x[0]  # a third are one vector
    return [(int(i), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("n, spread", [(700, 0.3), (5, 1.0), (1, 1.0), (40, 0.0)])
def test_centroids(spark, n, spread, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    rows = vectors(n, n, spread=spread)
    odd = [(9001, None), (9002, [1.0] * 63), (9003, [float("nan")] * 64), (9004, [float("inf")] * 64), (9005, [None] * 64), (9006, []), (None, [0.5] * 64), (3, rows[0][1])]
    df = spark.createDataFrame([(*x, 1, "v", "c") for x in rows + odd], VECTORS).repartition(3)
    expected, centres = brute.kmeans(rows + odd)
    got, found = centroids.clusters(df)
    assert found.tolist() == centres and as_set(got) == by_repr(expected)
    total, per = sum(d for *_, d in expected), {}
    for _, c, d in expected:
        per[c] = per.get(c, 0) + d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    assert as_set(centroids.digests(df)) == by_repr((i, c, d, per[c], total, name[c]) for i, c, d in expected)


def test_centroids_of_nothing(spark):
    assert centroids.digests(spark.createDataFrame([], VECTORS)).count() == 0
    assert centroids.digests(spark.createDataFrame([(1, [1e30] * 64, 1, "v", "c")], VECTORS)).count() == 0


def test_bounds_settle_most_vectors():
    r = np.random.default_rng(4)
    c = (r.normal(0, 1, (8, 16)) * 1000).astype(np.int64)
    x = np.concatenate([m + r.integers(-200, 200, (500, 16)) for m in c])
    near, second, upper, lower = np.zeros(4000, np.int64), np.ones(4000, np.int64), np.full(4000, np.inf), np.zeros(4000)
    centroids.Search(c, None).run(x, near, second, upper, lower)
    looked, plain = [], centroids._distances
    centroids._distances = lambda a, b: looked.append(len(a)) or plain(a, b)
    try:
        centroids.Search(c + 3, c).run(x, near, second, upper, lower)
    finally:
        centroids._distances = plain
    assert sum(looked) < 400 and (near == ((x[:, None] - c - 3) ** 2).sum(2).argmin(1)).all()
