import numpy as np
import pytest

from cindergrid.operators.forest import Tree, nearest_forest, search_cell
from cindergrid.operators.neighbors import knn_classify, nearest

SCHEMA = "id bigint, vector array<double>"


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA)


def pairs(df):
    return {(r.query_id, r.neighbour_id): r.distance for r in df.collect()}


def clustered(n, dims=64, centres=60, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(centres, dims)) * 2)[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * 0.7


def test_recall_in_64_dimensions_with_bounded_work(spark):
    v = clustered(6000)
    base = frame(spark, v)
    asked = base.filter("id % 20 = 0")
    options = dict(trees=6, cells=2, leaves=4, leaf=32, block=1024)
    want = pairs(nearest(asked, base, 10, exclude_self=True))
    got = pairs(nearest_forest(asked, base, 10, exclude_self=True, **options))
    assert len(want) == 3000 and len(want.keys() & got.keys()) >= 0.95 * len(want)
    assert all(abs(got[p] - np.linalg.norm(v[p[0]] - v[p[1]])) < 1e-9 for p in got)
    # 6 * 2 * 4 * 32 distances a query instead of 6,000.
    again = pairs(nearest_forest(asked, base.repartition(5), 10, exclude_self=True, **options))
    assert again == got


def test_distances_per_query_do_not_grow_with_the_rows(monkeypatch):
    from cindergrid.operators import forest

    real, seen = forest._nearest_in_block, []
    monkeypatch.setattr(forest, "_nearest_in_block", lambda q, b, ids, k: seen.append(len(q) * len(b)) or real(q, b, ids, k))
    for n in (500, 2000, 8000):
        v = clustered(n, 16)
        seen.clear()
        search_cell(v[:50], v, np.arange(n), 5, 32, 4, 1)
        assert sum(seen) <= 50 * 4 * 33


@pytest.mark.parametrize("rows", [np.eye(64)[np.arange(2000) % 64] + np.eye(64)[np.arange(2000) // 64 % 64],
                                  np.random.default_rng(1).integers(0, 2, (2000, 20)).astype(float)])
def test_leaves_stay_small_for_vectors_of_few_values(rows):
    rows = np.unique(rows, axis=0)
    tree = Tree(rows, 4, 3)
    sizes = np.bincount(tree.home(rows), minlength=16)
    assert sizes.max() <= 2 * len(rows) / 16
    near = tree.closest(rows, 5)
    assert (near[:, 0] == tree.home(rows)).all() and all(len(set(x)) == 5 for x in near.tolist())


def test_hot_vector_and_overfull_cells(spark):
    v = clustered(1500, 8, 5)
    v[1000:] = v[0]
    base = frame(spark, v)
    # No sample to cut on: cells are cut by hash alone, queries into chunks.
    got = pairs(nearest_forest(base, base, 3, exclude_self=True, trees=2, leaves=64, block=100, sample=1))
    want = pairs(nearest(base, base, 3, exclude_self=True))
    assert got.keys() == want.keys()


def test_few_and_missing_rows(spark):
    v = clustered(12, 4)
    base = frame(spark, v).union(spark.createDataFrame([(99, None), (None, [0.0] * 4)], SCHEMA))
    assert len(pairs(nearest_forest(base, base.filter("id < 3 or id is null"), 5))) == 12 * 3
    assert len(pairs(nearest(base, base.filter("id < 3 or id is null"), 5))) == 12 * 3
    assert nearest_forest(base.filter("id < 0"), base, 5).count() == 0
    with pytest.raises(ValueError, match="no base rows"):
        nearest_forest(base, base.filter("id < 0"), 5)
    with pytest.raises(ValueError, match="at least 1"):
        nearest_forest(base, base, 5, leaves=0)


def test_votes_through_the_forest(spark):
    v = clustered(600, 16, 6)
    base = frame(spark, v).selectExpr("*", "cast(vector[0] > 0 as int) AS label")
    asked = base.filter("id % 10 = 0")
    exact = {r.id: r.prediction for r in knn_classify(asked, base, 5).collect()}
    found = {r.id: r.prediction for r in knn_classify(asked, base, 5, search=nearest_forest, leaf=32).collect()}
    assert exact.keys() == found.keys() and sum(exact[i] == found[i] for i in exact) >= 0.95 * len(exact)
