import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.functions.quantiles import quantiles, ranked_values
from boxwright.operators import clustering, merge_tree


@pytest.mark.parametrize("kind", ["ties", "wide", "tiny"])
def test_quantiles_are_those_of_percentile(spark, kind):
    r = np.random.default_rng(1)
    values = {"ties": r.integers(0, 4, 3000) / 7, "wide": 10.0 ** r.uniform(-30, 30, 700) * r.choice([-1, 1], 700), "tiny": np.array([5e-324, 0.0, -5e-324, 1.0, np.nextafter(1, 2)])}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(4)
    shares = [0.0, 0.013, 0.5, 0.7, 0.95, 1.0]
    expected = df.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0]
    assert quantiles(df, "x", shares) == pytest.approx(expected, rel=1e-12)
    ordered = sorted(values.tolist())
    assert ranked_values(df, "x", [0, 3, len(values) - 1, len(values)]) == {k: ordered[k] for k in (0, 3, len(values) - 1)}
    assert quantiles(df.limit(0), "x", [0.5]) == [None]


def every_count(edges, least):
    """Clusters at every height, from the components there."""
    out = {}
    for h in sorted({w for *_, w in edges}):
        root = {}
        top = lambda x: x if root.setdefault(x, x) == x else top(root[x])  # noqa: E731, B023
        for a, b, w in edges:
            if w <= h:
                root[top(a)] = top(b)
        sizes = {}
        for x in list(root):
            sizes[top(x)] = sizes.get(top(x), 0) + 1
        out[h] = sum(n >= least for n in sizes.values())
    return out


@pytest.mark.parametrize(("least", "block", "ties"), [(2, 1000, False), (5, 45, False), (3, 60, True)])
def test_cluster_counts_at_every_height(spark, least, block, ties):
    r = np.random.default_rng(least + block)
    edges = []
    for i in range(1, 150):
        if i % 40:
            w = r.uniform(0, 1)
            edges.append((int(r.integers(i - i % 40, i)), i, float(round(w, 1) if ties else w)))
    forest = spark.createDataFrame(edges, "a bigint, b bigint, w double").repartition(3)
    got = {x["w"]: x["n"] for x in merge_tree.cluster_counts(forest, least, block).collect()}
    expected, n = every_count(edges, least), 0
    for h, count in expected.items():
        n = got.get(h, n)
        assert n == count, h
    for wanted, highest in ((1, 2.0), (4, 2.0), (9, 0.5), (1000, 0.9)):
        h = merge_tree.nearest_height(spark.createDataFrame(list(got.items()), "w double, n bigint"), forest, wanted, highest)
        allowed = {k: v for k, v in expected.items() if k <= highest and k >= min(got)}
        assert h == max(allowed, key=lambda k: (-abs(allowed[k] - wanted), k))


def test_clusters_come_nearest_to_the_number_wanted(spark):
    r = np.random.default_rng(6)
    middles = r.normal(size=(7, 8))
    rows = [(i, (middles[i % 7] + r.normal(0, 0.03, 8)).tolist()) for i in range(210)]
    df = spark.createDataFrame(rows, "roi_index int, embedding array<float>")
    got = {x["roi_index"]: x["cluster"] for x in clustering.clusters(df, n_neighbors=12, approx_n_clusters=7, base_min_cluster_size=5).collect()}
    assert len(got) == 210 and sorted(set(got.values()) - {-1}) == list(range(7))
    assert all(len({got[i] for i in range(k, 210, 7)} - {-1}) == 1 for k in range(7))


def test_sheet_groups_and_first_pages(spark):
    df = spark.createDataFrame([(i, "noise" if i % 5 == 0 else None if i % 5 == 1 else "a", i % 3 - 1) for i in range(30)], "roi_index int, new_label string, evoc_clust int")
    assert {r["group"] for r in clustering.sheet_groups(df).collect()} == {"a"} and clustering.sheet_groups(df).count() == 18
    assert {r["group"] for r in clustering.sheet_groups(df, "evoc_clust").collect()} == {"0", "1"}
    many = spark.range(700).select(F.lit("g").alias("group"), F.col("id").cast("int").alias("roi_index"))
    whole, first = clustering.contact_sheet(many, 100, 100), clustering.contact_sheet(many, 100, 100, first_page_only=True)
    assert whole.agg(F.max("page")).first()[0] > 1 and 0 < first.count() < 700 and first.filter("page <> 1").count() == 0


def plain_clusters(ids, vectors, k, min_samples, least, noise, wanted):
    """The same clusters by whole matrices: neighbours, mutual reachability, Kruskal, the height with the nearest number."""
    x = np.array(vectors, np.float64)
    x = x - x.mean(0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = np.sqrt(np.clip(2 - 2 * x @ x.T, 0, None))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    core = d[np.arange(len(x)), order[:, min(min_samples, k) - 1]]
    edges = sorted({(max(d[i, j], core[i], core[j]), min(i, j), max(i, j)) for i in range(len(x)) for j in order[i]})
    root = list(range(len(x)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    forest = []
    for w, i, j in edges:
        if top(i) != top(j):
            root[top(i)] = top(j)
            forest.append((i, j, w))
    limit = max(np.quantile(core, 1 - noise), min(w for *_, w in forest))
    counts = every_count(forest, least)
    height = min((w for w in counts if w <= limit), key=lambda w: (abs(counts[w] - wanted), -w))
    root = list(range(len(x)))
    for i, j, w in forest:
        if w <= height:
            root[top(i)] = top(j)
    groups = {}
    for i in range(len(x)):
        groups.setdefault(top(i), set()).add(ids[i])
    return {frozenset(g) for g in groups.values() if len(g) >= least}


def test_clusters_of_the_given_vectors_against_whole_matrices(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").limit(150).collect()
    df = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in rows], "roi_index int, embedding array<float>")
    got = {}
    for r in clustering.clusters(df, n_neighbors=15, approx_n_clusters=9, base_min_cluster_size=4).collect():
        got.setdefault(r["cluster"], set()).add(r["roi_index"])
    expected = plain_clusters([r["vec_id"] for r in rows], [r["embedding"] for r in rows], 15, 5, 4, 0.2, 9)
    assert {frozenset(g) for c, g in got.items() if c >= 0} == expected


def unit_rows(seed, n, groups, dims=16, spread=0.4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(groups, dims))[r.integers(0, groups, n)] + r.normal(0, spread, (n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def found_share(spark, x, k, **how):
    from boxwright.operators.neighbour_graph import near_graph

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "roi_index int, u array<double>").repartition(4)
    graph, share = near_graph(df, k, **how)
    rows = graph.collect()
    d = np.clip(2 - 2 * x @ x.T, 0, None)
    np.fill_diagonal(d, np.inf)
    last = np.sqrt(np.sort(d, axis=1)[:, k - 1]) + 1e-9
    assert len(rows) == len(x) * k and len({(r["a"], r["b"]) for r in rows}) == len(rows) and all(r["a"] != r["b"] for r in rows)
    assert all(abs(np.sqrt(d[r["a"], r["b"]]) - r["d"]) < 1e-6 for r in rows[:500])
    return sum(r["d"] <= last[r["a"]] for r in rows) / len(rows), share


def test_the_graph_finds_nine_in_ten_and_says_so(spark):
    x = unit_rows(1, 3000, 40)
    got, said = found_share(spark, x, 10, recall=0.93, cell_rows=60)
    assert got >= 0.9 and abs(got - said) < 0.05
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("embedding").collect()
    y = np.array([r["embedding"] for r in given], np.float64)
    y = (y - y.mean(0)) / np.linalg.norm(y - y.mean(0), axis=1, keepdims=True)
    assert found_share(spark, y, 10, cell_rows=25)[0] >= 0.9


def test_the_graph_with_a_vector_that_a_third_of_the_rows_have(spark):
    x = unit_rows(2, 1500, 30)
    x[:500], x[600:603] = x[0], x[600]
    got, _ = found_share(spark, x, 6, recall=0.95, cell_rows=50)
    assert got >= 0.9


def test_the_work_of_the_graph_grows_with_the_rows(spark, monkeypatch):
    done, plain = spark.sparkContext.accumulator(0), clustering._nearest

    def counted(a, x, b, y, k):
        done.add(len(x) * len(y))
        return plain(a, x, b, y, k)

    monkeypatch.setattr(clustering, "_nearest", counted)
    per_row = []
    for n in (1500, 6000):
        before = done.value
        assert found_share(spark, unit_rows(3, n, n // 50), 5, cell_rows=50)[0] >= 0.9
        per_row.append((done.value - before) / n)
    assert per_row[1] < 2 * per_row[0]


def test_clusters_by_the_graph(spark, monkeypatch):
    monkeypatch.setattr(clustering, "EXACT_ROWS", 100)
    r = np.random.default_rng(6)
    middles = r.normal(size=(5, 8))
    df = spark.createDataFrame([(i, (middles[i % 5] + r.normal(0, 0.03, 8)).tolist()) for i in range(300)], "roi_index int, embedding array<float>")
    got = {x["roi_index"]: x["cluster"] for x in clustering.clusters(df, n_neighbors=12, approx_n_clusters=5, base_min_cluster_size=5).collect()}
    assert sorted(set(got.values()) - {-1}) == list(range(5)) and all(len({got[i] for i in range(k, 300, 5)} - {-1}) == 1 for k in range(5))


def test_groups_of_cells_find_what_single_cells_find(spark, monkeypatch):
    """A row goes to a group once, however many of its cells it looks into."""
    from boxwright.operators import neighbour_graph

    x = np.random.default_rng(8).normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    units = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "roi_index int, u array<double>").cache()
    found = []
    for groups, rows in ((1000, 1), (1, 10_000), (3, 100)):
        monkeypatch.setattr(neighbour_graph, "GROUPS", groups)
        monkeypatch.setattr(neighbour_graph, "GROUP_ROWS", rows)
        near, share = neighbour_graph.near_graph(units, 5, cell_rows=50)
        found.append({(r["a"], r["b"], round(r["d"], 9)) for r in near.collect()})
        assert share >= 0.95
    assert found[0] == found[1] == found[2] and len(found[0]) == 3000


def test_clusters_beyond_a_side_are_those_of_whole_matrices(spark, monkeypatch):
    """Neighbours are exact whatever the number of rows: here a part holds 60 of 400, many of them copies."""
    monkeypatch.setattr(clustering, "EXACT_ROWS", 60)
    r = np.random.default_rng(9)
    x = r.normal(size=(400, 24)).astype(np.float32).astype(np.float64)
    x[:120], x[200:210] = x[0], x[200]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "roi_index int, embedding array<float>").repartition(5)
    u = x - x.mean(0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = np.sqrt(np.clip(2 - 2 * u @ u.T, 0, None))
    d[d < 1e-7] = 0
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :12]
    units = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "roi_index int, u array<double>")
    got = {}
    for row in clustering.neighbours(units, 12).orderBy("a", "d", "b").collect():
        got.setdefault(row["a"], []).append(row["b"])
    assert got == {i: order[i].tolist() for i in range(400)}
    found = {}
    for row in clustering.clusters(df.filter("roi_index >= 119"), n_neighbors=12, approx_n_clusters=9, base_min_cluster_size=4).collect():
        found.setdefault(row["cluster"], set()).add(row["roi_index"])
    ids = list(range(119, 400))
    assert {frozenset(g) for c, g in found.items() if c >= 0} == plain_clusters(ids, x[119:], 12, 5, 4, 0.2, 9)


def test_vectors_nearer_than_single_floats_can_tell():
    """A cluster narrower than the error of single floats, passing by in pieces: still the nearest by distance and id."""
    r = np.random.default_rng(10)
    x = np.concatenate([np.ones((300, 32)) + r.normal(0, 1e-5, (300, 32)), r.normal(size=(100, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = r.permutation(400).astype(np.int64)
    d = np.array([[np.sqrt(max(2 - 2 * (a * b).sum(), 0)) for b in x] for a in x])
    np.fill_diagonal(d, np.inf)
    best, who = clustering._none_yet(400, 7)
    for j in range(0, 400, 90):
        clustering._closer(best, who, ids, x, ids[j : j + 90], x[j : j + 90])
    assert np.allclose(best, np.sort(d, axis=1)[:, :7], atol=1e-7)
    assert all(len(set(w)) == 7 and ids[i] not in w for i, w in enumerate(who.tolist()))
