import numpy as np
import pytest
from pyspark.sql import functions as F

from cindergrid.operators import neighbors, sampling
from cindergrid.operators.neighbors import knn_classify, nearest, nearest_approximate


def points(spark, n=400, dims=3, hot=0, seed=0):
    """Random vectors, the last ``hot`` of which are one and the same."""
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, dims)), 3)
    if hot:
        v[n - hot:] = v[0]
    return v, spark.createDataFrame([(i, [float(x) for x in row], int(i % 9 == 0)) for i, row in enumerate(v)],
                                    "id bigint, vector array<double>, label int")


def brute(q, b, k, exclude):
    out = {}
    for i, x in enumerate(q):
        d = ((b - x) ** 2).sum(axis=1)
        order = sorted((d[j], j) for j in range(len(b)) if not (exclude and i == j))[:k]
        out[i] = [(j, np.sqrt(dd)) for dd, j in order]
    return out


@pytest.mark.parametrize("block,pivots,hot", [(4096, 1024, 0), (20, 12, 0), (16, 6, 150), (7, 40, 0)])
def test_nearest_is_exact(spark, block, pivots, hot):
    v, df = points(spark, hot=hot)
    want = brute(v, v, 4, True)
    got = {}
    for r in nearest(df, df, 4, exclude_self=True, block=block, max_pivots=pivots).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.neighbour_id, r.distance))
    assert len(got) == len(v)
    for i, expected in want.items():
        found = sorted(got[i])
        assert [f[1] for f in found] == [e[0] for e in expected]
        assert [f[2] for f in found] == pytest.approx([e[1] for e in expected])


def test_fewer_base_rows_than_k(spark):
    _, df = points(spark, 6)
    out = nearest(df, df.filter("id < 3"), 5)
    assert out.count() == 18


def test_classifier_votes(spark):
    base = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 1), (2, [2.0], 1), (3, [9.0], 0)], "id bigint, vector array<double>, label int")
    q = spark.createDataFrame([(10, [1.1]), (11, [0.0])], "id bigint, vector array<double>")
    got = {r.id: (r.probability, r.prediction) for r in knn_classify(q, base, 3).collect()}
    assert got == {10: (pytest.approx(2 / 3), 1), 11: (pytest.approx(2 / 3), 1)}
    weighted = {r.id: r.prediction for r in knn_classify(q, base, 3, weights="distance").collect()}
    assert weighted == {10: 1, 11: 0}


def test_smote_balances_between_neighbours(spark):
    v, df = points(spark, 90)
    out = sampling.smote(df, block=16)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 80, 1: 80} and out.filter("copy = 0").count() == 90
    minority = [i for i in range(90) if i % 9 == 0]
    near = brute(v[minority], v[minority], 5, True)
    per_base = {}
    for r in out.filter("copy > 0").collect():
        per_base[r.id] = per_base.get(r.id, 0) + 1
        a = v[r.id]
        ends = [v[minority[j]] for j, _ in near[minority.index(r.id)]]
        off = [np.linalg.norm(np.cross(b - a, np.array(r.vector) - a)) / np.linalg.norm(b - a) for b in ends]
        assert min(off) < 1e-9
    assert set(per_base.values()) <= {7} and len(per_base) == 10
    again = sampling.smote(df).orderBy("id", "copy").collect()
    assert again == out.orderBy("id", "copy").collect()


def test_balanced_input_is_left_alone(spark):
    _, df = points(spark, 10)
    even = df.withColumn("label", (F.col("id") % 2).cast("int"))
    assert sampling.smote(even).count() == 10


def test_too_small_a_class_is_an_error(spark):
    _, df = points(spark, 10)
    with pytest.raises(ValueError, match="smaller k"):
        sampling.smote(df.withColumn("label", (F.col("id") == 0).cast("int")))


def test_edited_neighbours(spark):
    data = [(0, [0.0], 0), (1, [0.1], 0), (2, [0.2], 0), (3, [0.3], 0), (4, [0.15], 1), (5, [9.0], 1), (6, [9.1], 1),
            (7, [9.2], 1), (8, [9.3], 1)]
    df = spark.createDataFrame(data, "id bigint, vector array<double>, label int")
    kept = sorted(r.id for r in sampling.edited_neighbours(df).collect())
    assert kept == [5, 6, 7, 8]


def test_split_is_stable_and_about_the_share(spark):
    df = spark.range(5000)
    a = sampling.random_split(df, ["id"])
    share = a.filter("split = 'test'").count() / 5000
    assert 0.17 < share < 0.23
    assert a.exceptAll(sampling.random_split(df.repartition(5), ["id"])).count() == 0
    assert sampling.random_split(df, ["id"], seed=1).exceptAll(a).count() > 0


def test_stratified_split_is_exact(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    got = {(r.y, r.split): r["count"] for r in sampling.stratified_split(df, ["id"], "y").groupBy("y", "split").count().collect()}
    assert got == {(0, "test"): 180, (0, "train"): 720, (1, "test"): 20, (1, "train"): 80}


def test_batches_are_full(spark):
    days = spark.range(65).select(F.col("id").cast("int").alias("day_idx"))
    out = sampling.shuffled_batches(days, 30)
    sizes = {r.batch: r["count"] for r in out.groupBy("batch").count().collect()}
    assert sizes == {0: 30, 1: 30} and out.select("day_idx").distinct().count() == 60


def test_approximate_search_visits_few_cells_and_finds_most(spark):
    def work(n):
        rng = np.random.default_rng(n)
        centres = rng.normal(size=(20, 8)) * 4
        points = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, 8))
        df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, vector array<double>")
        near = nearest_approximate(df, df, 5, exclude_self=True, probes=4, block=64)
        got = {(r.query_id, r.neighbour_id) for r in near.collect()}
        d = ((points[:, None] - points[None]) ** 2).sum(-1)
        np.fill_diagonal(d, np.inf)
        want = {(i, int(j)) for i in range(n) for j in np.argsort(d[i])[:5]}
        return len(got & want) / len(want), len(got) / n

    for n in (400, 1600):
        recall, found = work(n)
        assert recall >= 0.9 and found <= 5
    with pytest.raises(ValueError):
        nearest_approximate(spark.range(1), spark.range(1), 1, probes=0)


@pytest.mark.parametrize("hot", [0, 150])
def test_unpruned_search_shuffles_no_vectors(spark, monkeypatch, hot):
    """In 24 independent dimensions every cell would be visited: all blocks are compared, no vector sent to each of them."""
    v, df = points(spark, 500, 24, hot)
    calls, real = [], neighbors.compare_all
    monkeypatch.setattr(neighbors, "compare_all", lambda *a: calls.append(a) or real(*a))
    want, got = brute(v, v, 4, True), {}
    for r in nearest(df, df, 4, exclude_self=True, block=30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.neighbour_id, r.distance))
    assert len(calls) == 1
    for i, expected in want.items():
        assert [j for j, _ in got[i]] == [j for j, _ in expected]
        assert [x for _, x in got[i]] == pytest.approx([x for _, x in expected])


@pytest.mark.parametrize("scale,offset,dims", [(1, 0, 6), (1e-20, 0, 6), (1e18, 0, 6), (1, 1e6, 6), (1e-3, 1e9, 6), (1, 0, 1)])
def test_single_precision_only_leaves_out_what_is_farther(scale, offset, dims):
    """Numbers of any size, far from zero, with ties, nan and infinity: as if every pair were measured."""
    rng = np.random.default_rng(1)
    q, b = (np.round(rng.normal(size=(n, dims)), 2) * scale + offset for n in (600, 2500))
    q[3, 0], q[5, 0], b[7, 0], b[9] = np.nan, np.inf, np.inf, np.nan
    ids = rng.permutation(len(b))
    best = neighbors.Best(q, 4)
    best.add(b[:1500], ids[:1500])
    best.add(b[1500:], ids[1500:])
    rows, found, d2 = best.found()
    with np.errstate(all="ignore"):
        for i, x in enumerate(q):
            d = ((x - b) ** 2).sum(axis=1)
            known = np.flatnonzero(~np.isnan(d))
            order = known[np.lexsort((ids[known], d[known]))][:4]
            assert found[rows == i].tolist() == ids[order].tolist() and d2[rows == i].tolist() == d[order].tolist()


def test_later_rows_are_not_measured_one_by_one(monkeypatch):
    """Once near rows are known, far ones are left out by their inner products."""
    rng = np.random.default_rng(2)
    measured, real = [], neighbors.Best._measure
    monkeypatch.setattr(neighbors.Best, "_measure", lambda self, r, *a: measured.append(len(r)) or real(self, r, *a))
    best = neighbors.Best(rng.normal(size=(1000, 32)), 4)
    for i in range(10):
        best.add(rng.normal(size=(1000, 32)), np.arange(1000) + 1000 * i)
    assert sum(measured) < 1000 * 40


def test_each_query_leaves_the_comparison_once(spark):
    """With more blocks of queries than tasks, what is returned is k rows a query, however many base blocks there are."""
    v, df = points(spark, 1500, 24)
    rows = df.select(F.col("id").alias("q"), F.col("vector").alias("v"))
    out = neighbors.compare_all(rows, rows.withColumnRenamed("q", "id"), 4, 10)
    assert out.count() == 4 * len(v)
