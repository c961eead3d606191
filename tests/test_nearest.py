"""k nearest neighbours with pivots against the search of everything."""

import numpy as np
import pytest

from pairlab.operators import nearest
from pairlab.operators.nearest import knn_join_pivots
from pairlab.operators.retrieve import knn_join, nearest_rows


def _frames(spark, q, c, ids=int):
    rows = lambda m, name: spark.createDataFrame([(ids(i), v if v is None else [float(x) for x in v], "extra") for i, v in enumerate(m)],
                                                 f"{name} {'long' if ids is int else 'string'}, embedding array<double>, cell string")
    return rows(q, "query_id"), rows(c, "neighbor_id")


def _rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "neighbor_id", "dist").collect())


@pytest.mark.parametrize("ids", [int, str])
def test_equals_full_search(spark, ids):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5)) * 20
    c = [*(centres[rng.integers(0, 6, 250)] + rng.normal(size=(250, 5))), *[centres[0]] * 40, None]
    q = [*(centres[rng.integers(0, 6, 40)] + rng.normal(size=(40, 5))), centres[0], None, np.zeros(5)]
    qf, cf = _frames(spark, q, c, ids)
    for k, keys in ((3, {}), (50, {}), (4, {"qkey": "query_id", "ckey": "neighbor_id"})):
        got = knn_join_pivots(qf, cf, k=k, block_rows=16, **keys)
        assert _rows(got.rows) == _rows(knn_join(qf, cf, k=k, **keys))


def test_work_is_less_on_clusters_and_bounded_elsewhere(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 4)) * 100
    c = centres[rng.integers(0, 12, 1200)] + rng.normal(size=(1200, 4))
    qf, cf = _frames(spark, c[:200], c)
    r = knn_join_pivots(qf, cf, k=3, block_rows=32).report().first()
    assert r.n_all_distances == 240_000 and r.n_row_distances + r.n_pivot_distances < 0.5 * r.n_all_distances
    flat = rng.normal(size=(300, 40))
    qf, cf = _frames(spark, flat[:50], flat)
    r = knn_join_pivots(qf, cf, k=3, block_rows=32).report().first()
    assert r.n_row_distances <= r.n_all_distances


def test_hot_cell_is_split(spark, monkeypatch):
    c = [np.array([1.0, 1.0 + i * 1e-3]) for i in range(300)]
    qf, cf = _frames(spark, c[:20], c)
    got = knn_join_pivots(qf, cf, k=2, pivots=1, block_rows=10)
    assert got.n_pivots == 1 and _rows(got.rows) == _rows(knn_join(qf, cf, k=2))
    assert got.report().first().n_row_distances < 20 * 300 / 2
    monkeypatch.setattr(nearest, "MAX_BLOCKS", 3)
    assert _rows(knn_join_pivots(qf, cf, k=2, pivots=1, block_rows=10).rows) == _rows(knn_join(qf, cf, k=2))


def test_empty_sides(spark):
    qf, cf = _frames(spark, [np.zeros(2)], [np.zeros(2)])
    assert knn_join_pivots(qf, cf.where("false")).rows.count() == 0
    assert knn_join_pivots(qf.where("false"), cf).rows.count() == 0
    assert knn_join_pivots(qf, cf.where("false")).report().first().n_row_distances == 0


def test_queries_travel_once_per_slab(spark, monkeypatch):
    """Vectors without clusters reach every block; a query is sent to slabs of blocks, not to each block."""
    rng = np.random.default_rng(6)
    flat = [*rng.normal(size=(150, 12)), *[np.ones(12)] * 6]
    qf, cf = _frames(spark, flat[:60], flat)
    keys = {"qkey": "query_id", "ckey": "neighbor_id"}
    want = _rows(knn_join(qf, cf, k=3, **keys))
    got = knn_join_pivots(qf, cf, k=3, block_rows=4, **keys)
    assert _rows(got.rows) == want and got.searched.count() <= 2 * 60
    for name, value in (("SLAB_VALUES", 12 * 40), ("CHUNK", 16), ("ROUTED", 7), ("ASKED", 5)):
        monkeypatch.setattr(nearest, name, value)
    got = knn_join_pivots(qf, cf, k=3, block_rows=4, **keys)
    assert _rows(got.rows) == want and 60 < got.searched.count() <= 2 * 60 * 4


def test_equal_keys_are_left_out_without_a_matrix_of_them():
    rng = np.random.default_rng(7)
    q, c = rng.integers(0, 3, (20, 2)).astype("float64"), rng.integers(0, 3, (30, 2)).astype("float64")
    qkey, ckey = (np.array([f"k{x}" for x in rng.integers(0, 9, n)]) for n in (20, 30))
    dist = ((q[:, None] - c[None]) ** 2).sum(axis=2)
    dist[qkey[:, None] == ckey[None]] = np.inf
    want = [(i, j) for i in range(20) for j in np.lexsort((np.arange(30), dist[i]))[:4].tolist() if np.isfinite(dist[i, j])]
    kth = np.sort(dist, axis=1)[:, 3]
    for bound in (None, kth):
        row, col, _ = nearest_rows(q, c, np.arange(30), qkey, ckey, 4, bound)
        assert list(zip(row.tolist(), col.tolist(), strict=True)) == want
