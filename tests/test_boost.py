"""Boosted trees: kernels, chunks, early stopping, groups, quality bands."""

import numpy as np
import pytest

from panelkit.operators import boost as B


def planted(n, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 5))
    x[r.random((n, 5)) < 0.05] = np.nan
    clean = np.nan_to_num(x, nan=-1.0)
    y = 2.0 * (clean[:, 0] > 0.3) + clean[:, 1] - 1.5 * (clean[:, 2] < -0.5) * (clean[:, 1] > 0) + 0.3 * r.normal(size=n)
    return x, y


def frame(spark, x, y, parts=2, **more):
    rows = [(*[None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join([f"a{i} double" for i in range(x.shape[1])] + ["y double"])).repartition(parts)


FEATS = [f"a{i}" for i in range(5)]


def test_best_split_is_the_exhaustive_one():
    r = np.random.default_rng(4)
    p = B.Params(l2=0.7, l1=0.2, min_child=2)
    x, y = r.integers(0, 9, (60, 3)).astype(float), r.normal(size=60)
    x[r.random((60, 3)) < 0.2] = np.nan
    edges = [np.unique(c[np.isfinite(c)]) for c in x.T]
    codes = B.encode(edges, x)
    got = B.best_splits(B.histograms(codes, np.zeros(60, int), y, np.arange(3), 1, 12), p)[0]
    score = lambda v: max(abs(v.sum()) - p.l1, 0) ** 2 / (len(v) + p.l2)
    for f in range(3):
        best = -np.inf
        for e in edges[f]:
            for missing in (False, True):
                left = np.where(np.isnan(x[:, f]), missing, x[:, f] <= e)
                if left.sum() >= 2 and (~left).sum() >= 2:
                    best = max(best, score(y[left]) + score(y[~left]) - score(y))
        assert got[f, 0] == pytest.approx(best, rel=1e-9)


def test_quality_band_and_chunks(spark):
    x, y = planted(3000)
    train, test = frame(spark, x[:2000], y[:2000]), frame(spark, x[2000:], y[2000:])
    p = B.Params(rounds=150, rate=0.1)
    model = B.fit(train, FEATS, "y", p)
    assert len(model.trees) == 150 and model.best_iteration == 149
    got = np.array([(r.y, r.y_pred) for r in B.predict(model, test).collect()])
    mse = ((got[:, 0] - got[:, 1]) ** 2).mean()
    assert 0.09 * 0.9 < mse < 0.2  # the noise has variance 0.09, the labels about 2.5
    imp = B.importances(spark, model).collect()
    assert [r.feature for r in imp][:3] != [] and {r.feature for r in imp[:3]} == {"a0", "a1", "a2"}
    assert sum(r.importance for r in imp) == pytest.approx(1.0)
    again = B.fit(train, FEATS, "y", p, chunk=40)  # the chunk's size changes nothing
    for a, b in zip(model.trees, again.trees):
        assert (a.feature == b.feature).all() and np.allclose(a.value, b.value)


def test_many_blocks_grow_the_same_trees(spark):
    x, y = planted(900, 3)
    p = B.Params(rounds=5, rate=0.3, depth=3, rows=1.0, bins=32)
    train, valid = frame(spark, x[:600], y[:600], 1), frame(spark, x[600:], y[600:], 1)
    one = B.fit(train, FEATS, "y", p, valid)
    many = B.fit(train, FEATS, "y", p, valid, chunk=2, block_rows=100)
    assert len(one.trees) == len(many.trees) == 5 and np.allclose(one.curve, many.curve)
    for a, b in zip(one.trees, many.trees):
        assert (a.feature == b.feature).all() and np.allclose(a.value, b.value)


def test_early_stopping(spark):
    x, y = planted(1500, 5)
    noise = np.random.default_rng(0).normal(size=1500)
    p = B.Params(rounds=5000, rate=0.2, patience=20)
    train, valid = frame(spark, x[:700], (y + 2 * noise)[:700]), frame(spark, x[700:], (y + 2 * noise)[700:])
    model = B.fit(train, FEATS, "y", p, valid)
    assert len(model.trees) == model.best_iteration + 1 < 100
    assert len(model.curve) == model.best_iteration + 21 and min(model.curve) == model.curve[model.best_iteration]
    got = [(r.y - r.y_pred) ** 2 for r in B.predict(model, valid).collect()]
    assert np.mean(got) == pytest.approx(min(model.curve), rel=1e-9)


def test_groups(spark):
    x, y = planted(1200, 7)
    df = frame(spark, x, y).selectExpr("*", "monotonically_increasing_id() as id")
    df = df.selectExpr("*", "case when id % 3 = 0 then null else id % 3 end as k",
                       "case when id % 10 < 7 then 'fit' when id % 10 < 9 then 'eval' else 'test' end as role")
    df = df.unionByName(df.limit(4).selectExpr("* except (k, role, y)", "99 as k", "'test' as role", "0.0 as y"))
    p = B.Params(rounds=400, rate=0.1, patience=15)
    models = B.fit_groups(df, FEATS, "y", ["k"], params=p)
    got = {r.k: r for r in models.collect()}
    assert set(got) == {None, 1, 2}
    for r in got.values():
        assert r.best_iteration == int(np.argmin(r.curve)) and len(r.curve) <= r.best_iteration + 16
    out = B.predict_groups(df, models, FEATS, ["k"]).collect()
    assert len(out) == 1204
    for k in (None, 1, 2):
        e = [(r.y - r.y_pred) ** 2 for r in out if r.k == k and r.role == "test"]
        assert np.mean(e) < 0.45
    assert all(r.y_pred is None for r in out if r.k == 99)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "a double, y double")
    model = B.fit(df, ["a"], "y", B.Params(rounds=3))
    assert [r.y_pred for r in B.predict(model, df).collect()] == [2.0, 2.0]
    with pytest.raises(ValueError):
        B.fit(df.limit(0), ["a"], "y")
