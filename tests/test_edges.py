"""Rows, folds and scores that must not get lost."""

import math

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E
from panelkit.operators import features as FE
from panelkit.operators import order as OR
from panelkit.operators import profile as PR
from panelkit.operators import score as S
from panelkit.plans import pipeline as PL
from panelkit.plans import scan
from panelkit.plans import walkforward as WF
from panelkit.sources import tables as T


def test_rows_with_null_keys_and_times_stay(spark):
    rows = [(1, 1, 1.0), (1, 2, 2.0), (None, 1, 3.0), (None, 2, 5.0), (1, None, 4.0)]
    df = spark.createDataFrame(rows, "series_id long, t long, x double")
    got = {(r.series_id, r.t): r.rn for r in scan.row_index(df, out="rn").collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (None, 1): 0, (None, 2): 1, (1, None): None}
    e = {(r.series_id, r.t): r.m for r in scan.ewm(df, "x", {"m": 0.5}, block_rows=1).collect()}
    assert e == {(1, 1): 1.0, (1, 2): 1.5, (None, 1): 3.0, (None, 2): 4.0, (1, None): None}


def test_every_fold_is_reported(spark):
    rng = np.random.default_rng(0)
    rows = [(s, i, float(rng.normal()), float(rng.normal()) / 100, 0.0) for s, n in ((1, 161), (2, 150), (3, 400))
            for i in range(n)]
    df = spark.createDataFrame(rows, "series_id long, t int, f double, forward_returns double, risk_free_rate double")
    df = df.selectExpr("series_id", "date_add(date'2020-01-01', t) as t", "f", "forward_returns", "risk_free_rate",
                       "ln(1 + forward_returns) as y")
    oof, folds = WF.walk_forward(df, ["f"], "y", 8, 20, gap=1)
    st = {(r.series_id, r.fold): r.status for r in folds.collect()}
    assert len(st) == 24
    assert {st[2, k] for k in range(1, 9)} == {"too_short"} and {st[3, k] for k in range(1, 9)} == {"ok"}
    assert st[1, 1] == "no_fit_rows" and st[1, 8] == "ok"
    n = {(r.series_id, r.fold): r["count"] for r in oof.groupBy("series_id", "fold").count().collect()}
    assert n == {(s, k): 20 for s in (1, 3) for k in range(1, 9)}


@pytest.mark.parametrize("returns", [[0.1, -1.0, 0.1], [0.1, -1.8, 0.1], [0.1, -1.8, -1.2, 0.3], [0.1, None, 0.2, -0.1]])
def test_scores_at_and_below_ruin(spark, returns):
    df = spark.createDataFrame([(1, i, r, 0.0, 1.0) for i, r in enumerate(returns)],
                               "series_id long, t int, forward_returns double, risk_free_rate double, position double")
    r = S.adjusted_sharpe(df, "series_id").first()
    x = pd.Series(returns, dtype=float)
    prod = (1 + x).prod()
    if prod < 0:
        assert r.status == "strategy_product_negative" and r.adjusted_sharpe is None
    else:
        want = (prod ** (1 / len(x)) - 1) / x.std() * math.sqrt(252)
        assert r.status == "ok" and r.adjusted_sharpe == pytest.approx(want, rel=1e-12)
    tot = df.agg(S.total_return("forward_returns").alias("t")).first().t
    assert tot == pytest.approx(prod - 1, rel=1e-12)
    curve = [q.cum_strategy for q in S.cumulative_curves(df, "series_id", ret="forward_returns").orderBy("t").collect()]
    assert curve == pytest.approx((1 + x.fillna(0)).cumprod().tolist(), abs=1e-12)
    if x.notna().all():
        dated = df.selectExpr("series_id", "date_add(date'2020-01-01', t) t", "forward_returns", "risk_free_rate", "position")
        eq = (1 + x).cumprod()
        got = S.perf_metrics(dated, "series_id").first()
        assert got.max_drawdown == pytest.approx((eq / eq.cummax() - 1).min(), abs=1e-12)


def test_gram_of_offset_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, 3000) + 1e8
    pdf = pd.DataFrame({"x": x, "y": x - 1e8 + rng.normal(0, 0.03, 3000)})
    df = spark.createDataFrame(pdf).repartition(7)
    c = {(r.feature_a, r.feature_b): r["corr"] for r in PR.corr_matrix(df, ["x", "y"]).collect()}
    assert c["x", "y"] == pytest.approx(np.corrcoef(pdf.x - 1e8, pdf.y)[0, 1], abs=1e-9)


def test_gram_wide(spark):
    p = 120
    rng = np.random.default_rng(2)
    m = rng.normal(size=(400, p))
    m[rng.random(m.shape) < 0.1] = np.nan
    cols = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame(pd.DataFrame(m, columns=cols)).repartition(5)
    got = np.full((p, p), np.nan)
    for r in PR.corr_matrix(df, cols).collect():
        got[int(r.feature_a[1:]), int(r.feature_b[1:])] = r["corr"]
    assert np.allclose(got, pd.DataFrame(m).corr().to_numpy(), atol=1e-10)


def test_sortedness_carries_over_gaps(spark):
    df = spark.createDataFrame([(1, 10), (2, 11), (200_000, 5)], "id long, ts long")
    assert tuple(OR.sortedness(df, "id", "ts").first()) == (False, 1)
    assert tuple(OR.sortedness(df.limit(0), "id", "ts").first()) == (None, 0)


def test_random_split_is_exact(spark):
    df = spark.range(1003).selectExpr("id")
    a = OR.random_split(df, ["id"], 0.7, 1)
    assert a.where("is_train").count() == 702
    b = OR.random_split(df, ["id"], 0.7, 1).where("is_train").collect()
    assert sorted(b) == sorted(a.where("is_train").collect())
    assert sorted(b) != sorted(OR.random_split(df, ["id"], 0.7, 2).where("is_train").collect())


def test_window_stats_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = pd.Series(rng.normal(size=300))
    x[rng.random(300) < 0.1] = np.nan
    df = spark.createDataFrame([(1, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)],
                               "series_id long, t int, x double")
    got = scan.window_stats(scan.row_index(df, out="rn"), "x", (5, 21), (1, 3), "series_id", "rn", 4, block_rows=32) \
        .toPandas().sort_values("t").reset_index(drop=True)
    u = x.shift(1)
    for k in (5, 21):
        assert np.allclose(got[f"mean_{k}"], u.rolling(k, 4).mean(), equal_nan=True)
        assert np.allclose(got[f"std_{k}"], u.rolling(k, 4).std(), equal_nan=True)
        assert np.allclose(got[f"cum_{k}"], u.rolling(k, 4).sum(), equal_nan=True)
        assert np.allclose(got[f"roc_{k}"], u / u.shift(k) - 1, equal_nan=True)
    assert np.allclose(got["lag_3"], x.shift(3), equal_nan=True)


@pytest.mark.parametrize("first", [False, True])
def test_pipeline_is_its_steps(spark, first):
    rng = np.random.default_rng(4)
    rows = [(s, i, float(rng.normal()), None if i % 9 == 0 else float(rng.normal()), 7.0, float(rng.normal()) / 100)
            for s in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "series_id long, t int, P1 double, E1 double, D1 double, "
                                     "market_forward_excess_returns double")
    out = PL.panel_pipeline(df, impute_first=first, stats=["mean_5", "lag_1", "ema_fast"]).toPandas()
    assert len(out) == 120 and str(out["date"].min()) == "1990-01-01"
    assert "E1_is_missing" in out and "P1" in out and "D1" not in out  # constants are guarded away
    known = set(FE.momentum_names() + FE.volatility_names())
    assert all(c in known for c in out if c.startswith(("MOM_", "VI_")))  # never extended themselves
    one = out[out.series_id == 1].sort_values("t").reset_index(drop=True)
    raw = pd.Series([r[3] for r in rows[:60]], dtype=float)
    u = (raw.fillna(FE.SENTINEL) if first else raw).shift(1)
    assert np.allclose(one["E1_mean_5"], u.rolling(5, 5).mean().fillna(FE.SENTINEL))


def test_null_key_queries_keep_all_series(spark):
    sf = "/root/testdata/sf0.01"  # series 13, 23, ... must stay
    rows = T.panel(spark, sf).count()
    series = T.panel(spark, sf).select("series_id").distinct().count()
    for name in ("w22_row_number_null_key", "w6_ewm_null_key"):
        got = E.queries()[name](spark, sf)
        assert got.count() == rows
        assert got.select("series_id").distinct().count() == series
