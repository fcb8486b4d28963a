"""Scorers and walk-forward fitters against plain computations."""

import math

import numpy as np
import pandas as pd
import pytest

from panelkit.operators import boost as B
from panelkit.operators import score as S
from panelkit.plans import walkforward as WF
from panelkit.plans.scorer import LinearScorer, python_scorer


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2)) * [1, 50] + [0, 1e4]
    y = 0.001 * x[:, 0] - 1e-5 * (x[:, 1] - 1e4) + 1e-4 * rng.normal(size=300)
    data = [(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    data += [(1000, None, 1.0, 0.0), (1001, 2.0, float("nan"), 0.0), (None, float("inf"), 3.0, 0.1), (1002, 0.5, 1e4, None)]
    return spark.createDataFrame(data, "id long, a double, b double, y double")


def test_linear_scorer_is_numpy_and_its_python_form(spark, rows):
    scorer = LinearScorer.fit(rows.where("not isnan(b) and a < 1e300"), ["a", "b"], "y", multiplier=40)
    pdf = rows.toPandas()
    ok = pdf[["a", "b"]].apply(np.isfinite).all(axis=1)
    train = pdf[ok & pdf.y.notna()]
    A = np.column_stack([np.ones(len(train)), train.a, train.b])
    w = np.linalg.lstsq(A, train.y, rcond=None)[0]
    want = np.clip(40 * (w[0] + w[1] * pdf.a + w[2] * pdf.b) + 1, 0, 2).where(ok)
    adapter = python_scorer(lambda x: np.clip(40 * (w[0] + w[1] * x.a + w[2] * x.b) + 1, 0, 2), ["a", "b"])
    for s in (scorer, adapter):
        got = s(rows).toPandas()
        assert list(got.columns) == ["id", "a", "b", "y", "prediction", "status"] and len(got) == len(pdf)
        m = got.merge(pdf.assign(want=want)[["id", "want"]], on="id", how="left")
        both = m.prediction.astype(float).to_numpy(), m.want.to_numpy()
        assert np.allclose(*both, equal_nan=True, atol=1e-9)
        assert set(got.status[got.prediction.isna()]) == {"missing_features"} and set(got.status[got.prediction.notna()]) == {"ok"}
    bad = python_scorer(lambda x: x.a / 0 if len(x) else x.a, ["a", "b"])(rows.where("id < 3")).collect()
    assert {r.status for r in bad} == {"invalid_prediction"} and all(r.prediction is None for r in bad)
    with pytest.raises(ValueError):
        LinearScorer.fit(rows.limit(0), ["a", "b"], "y")


def _panel(spark, n=460):
    rng = np.random.default_rng(8)
    data = []
    for s in (None, 1):
        f, g = rng.normal(size=n), rng.normal(size=n)
        y = 0.004 * f - 0.002 * (g > 0.5) + 0.002 * rng.normal(size=n)
        data += [(s, i, float(a), float(b), float(t), float(math.expm1(t)), 0.0001 * (1 + i % 3), float(abs(b)), i % 7 == 0)
                 for i, (a, b, t) in enumerate(zip(f, g, y))]
    df = spark.createDataFrame(data, "series_id long, t int, f double, g double, y double, forward_returns double, "
                                     "risk_free_rate double, v double, bad boolean")
    return df.selectExpr("series_id", "date_add(date'2020-01-01', t) as t", "f", "g", "y", "forward_returns", "risk_free_rate", "v",
                         "cast(bad as int) as regime"), pd.DataFrame(data, columns=["s", "t", "f", "g", "y", "fr", "rf", "v", "bad"])


def test_walk_forward_segments_are_plain_folds(spark):
    """Models, positions and fold table over segments against one fit per fold on copied rows."""
    df, pdf = _panel(spark)
    k, size, gap, n = 4, 50, 3, 460
    for block in (1 << 16, 260):
        oof, folds = WF.walk_forward(df, ["f", "g"], "y", k, size, gap, vol="v", regime="regime",
                                     fitter=WF.LinearFitter(block_rows=block))
        got = {(r.series_id, r.fold, (r.t - __import__("datetime").date(2020, 1, 1)).days): r for r in oof.collect()}
        table = {(r.series_id, r.fold): r for r in folds.collect()}
        assert len(got) == 2 * k * size and len(table) == 2 * k
        for s in (None, 1):
            d = pdf[pdf.s.isna() if s is None else pdf.s == s].reset_index(drop=True)
            for i in range(k):
                lo = n - (k - i) * size
                train = lo - gap
                fit = train - max(min(train // 5, 252), 50)
                A = np.column_stack([np.ones(n), d.f, d.g])
                w = np.linalg.lstsq(A[:fit], d.y[:fit], rcond=None)[0]
                p = A @ w
                e2 = pd.Series((d.y - p)[:train] ** 2)
                tail = math.sqrt(e2.rolling(126, min_periods=50).mean().iloc[-1])
                base = np.sqrt(e2.rolling(252, min_periods=50).mean()).median()
                mu, sigma = p[:train].mean(), p[:train].std()
                beta = 0.25 / (1 + 0.5 * d.v / d.v.median() + 0.5 * tail / base)
                pos = np.clip((1 + beta * (p - mu) / sigma) * np.where(d.bad, 0.5, 1), 0, 2)
                for t in range(lo, lo + size):
                    r = got[s, i + 1, t]
                    assert r.y_pred_log == pytest.approx(p[t], abs=1e-12) and r.position == pytest.approx(pos[t], abs=1e-9)
                row = table[s, i + 1]
                assert (row.train_size, row.test_size, row.status) == (train, size, "ok")
                assert row.rmse_factor == pytest.approx(tail / base, rel=1e-9)
                e = (d.y - p)[lo: lo + size]
                assert row.mse == pytest.approx((e ** 2).mean(), rel=1e-9)
                assert (row.test_end - row.test_start).days == size - 1 and (row.train_end - row.train_start).days == train - 1


def test_walk_forward_with_trees(spark):
    """Trees see fit and eval rows, stop by the eval rows and beat the mean on the test rows."""
    df, _ = _panel(spark)
    fitter = WF.TreeFitter(B.Params(rounds=300, rate=0.1, depth=3, patience=10, rows=0.8, columns=1.0))
    oof, folds = WF.walk_forward(df, ["f", "g"], "y", 3, 60, 1, vol="v", fitter=fitter)
    rows = folds.collect()
    assert len(rows) == 6 and all(0 <= r.best_iteration < 299 and r.r2 > 0.3 for r in rows)
    assert oof.count() == 360 and oof.where("position is null or position < 0 or position > 2").count() == 0
    assert S.MAX_INVESTMENT == 2.0
