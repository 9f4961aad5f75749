"""Learned text vectors against numpy's SVD, and against hashed words."""

import numpy as np
import pytest
from tiercat.operators import features as fe
from tiercat.operators import vectors as ve
from tiercat.plans import fixtures as fx

from folders import SF_MID


def _frame(spark, x):
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, indices array<int>, values array<double>").repartition(3)


@pytest.mark.parametrize("block", [4096, 7])
def test_singular_vectors(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(ve, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(80, 6)) * [9, 7, 5, 4, 3, 2]) @ rng.normal(size=(6, 40)) + .01 * rng.normal(size=(80, 40))
    x[rng.random(x.shape) < .3] = 0
    x[5] = 0
    e = ve.fit(_frame(spark, x), 40, dim=5)
    _, s, v = np.linalg.svd(x)
    assert np.allclose(e.values, s[:5], rtol=1e-3)
    w = e.matrix()
    assert np.allclose(w.T @ w, np.eye(5), atol=1e-5) and np.allclose(np.abs(np.diag(v[:5] @ w)), 1, atol=1e-3)
    got = {r.id: np.array(r.text_vec) for r in e.encode(_frame(spark, x)).collect()}
    want = x @ w
    for i in range(80):
        n = np.linalg.norm(want[i])
        assert np.allclose(got[i], want[i] / n if n else 0, atol=1e-4)
    e.save(str(tmp_path / "e"))
    assert (ve.load(spark, str(tmp_path / "e")).matrix() == w).all()


def test_awkward_rows(spark):
    e = ve.fit(_frame(spark, np.eye(3)), 3, dim=8)  # fewer terms than directions
    got = np.array([r.text_vec for r in e.encode(_frame(spark, np.eye(3))).collect()])
    assert got.shape == (3, 8) and np.allclose(got @ got.T, np.eye(3), atol=1e-5) and not got[:, 3:].any()
    none = ve.fit(_frame(spark, np.eye(3)).where("false"), 3, dim=2)
    assert all(not any(r.text_vec) for r in none.encode(_frame(spark, np.eye(3))).collect())
    with pytest.raises(ValueError):
        ve.fit(_frame(spark, np.eye(3)), 10**8)


def neighbours_alike(train, val):
    """Share of ``val`` (vector, class) whose nearest ``train`` row has their class."""
    a, b = (np.array([v for v, _ in d], np.float32) for d in (train, val))
    return float(np.mean([train[j][1] == c for j, (_, c) in zip((b @ a.T).argmax(axis=1), val)]))


def test_neighbours_share_the_class_as_often_as_with_hashing(spark):
    rows = fx.feature_rows(spark, SF_MID)
    size = fx.text_features(spark, SF_MID).model.size
    e = ve.fit(rows.where("split = 'train'"), size, dim=64)
    learned = e.encode(rows.select("doc_id", "split", "category_id", "indices", "values")).collect()
    hashed = fe.HashingEncoder(64).encode(fx.prepared_txn(spark, SF_MID).rows, "clean_description").select(
        "split", "category_id", "text_vec").collect()
    share = []
    for d in (learned, hashed):
        train, val = ([(r.text_vec, r.category_id) for r in d if r.split == s] for s in ("train", "val"))
        share.append(neighbours_alike(train, val))
    assert share[0] >= share[1]


def test_tasks_follow_the_sums_not_the_rows(spark, monkeypatch):
    seen, added_up = [], ve.added_up
    monkeypatch.setattr(ve, "added_up", lambda parts, *a, **k: (seen.append(parts.rdd.getNumPartitions()),
                                                               added_up(parts, *a, **k))[1])
    monkeypatch.setattr(ve, "PASS_BYTES", 0)
    x = np.random.default_rng(2).normal(size=(90, 20))
    e = ve.fit(_frame(spark, x).repartition(30), 20, dim=4)
    assert seen[0] <= spark.sparkContext.defaultParallelism
    assert np.allclose(e.values, np.linalg.svd(x)[1][:4], rtol=1e-3)


def test_products_of_slices_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((90, 30)) * (rng.random((90, 30)) < np.linspace(.01, .9, 30))
    x[7] = 0
    ends, at = np.append(0, (x > 0).sum(axis=1).cumsum()), np.nonzero(x)
    d = rng.normal(size=(30, 4)).astype(np.float32)
    for dense in (0, .3, 2):
        monkeypatch.setattr(ve, "DENSE", dense)
        p = ve.Product(d)
        for a in range(0, 90, 25):
            e = ends[a:min(a + 25, 90) + 1]
            y, rest = p.times(e - e[0], at[1][e[0]:e[-1]], x[at][e[0]:e[-1]].astype(np.float32))
            assert np.allclose(y, x[a:a + 25] @ d, atol=1e-5)
            p.add(y, rest)
        assert np.allclose(p.total(), x.T @ (x @ d), atol=1e-3) and (p.total() == p.total()).all()
    assert not ve.Product(d).total().any()


def test_rows_of_counts_give_the_vectors_of_weights(spark, monkeypatch):
    monkeypatch.setattr(ve, "SLICE_ROWS", 7)
    rng = np.random.default_rng(4)
    tf = rng.integers(1, 4, (60, 20)) * (rng.random((60, 20)) < .4)
    tf[5] = 0
    idf, rows = rng.random(20) + 1, []
    for i, r in enumerate(tf):
        at = np.flatnonzero(r)
        w = (1 + np.log(r[at])) * idf[at]
        n = float(np.sqrt((w * w).sum()))
        rows.append((i, at.tolist(), r[at].tolist(), n, (w / (n or 1)).tolist()))
    d = spark.createDataFrame(rows, "id long, indices array<int>, tf array<int>, norm double, values array<double>").repartition(3)
    a, b = ve.fit(d, 20, dim=3), ve.fit(d, 20, dim=3, idf=idf)
    assert np.allclose(a.values, b.values, rtol=1e-4)
    for m, got in ((b, b.encode(d.drop("values"), idf=idf)), (a, a.encode(d.select("id", "indices", "values")))):
        v = {r.id: np.array(r.text_vec) for r in got.collect()}
        want = np.array([w @ m.matrix()[at] if at else np.zeros(3) for _, at, _, _, w in rows])
        norms = np.linalg.norm(want, axis=1, keepdims=True)
        assert np.allclose([v[i] for i in range(60)], want / np.where(norms > 0, norms, 1), atol=1e-4)
        assert not v[5].any()
