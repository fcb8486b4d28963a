"""Window operators and scores against independent pandas computations."""
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelkit.operators import rolling as R
from panelkit.operators import score as S
from panelkit.operators import features as FE


def _df(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    fr = rng.normal(0, 0.01, n)
    rf = np.abs(rng.normal(0.0001, 0.00005, n))
    pos = np.clip(1 + rng.normal(0, 0.5, n), 0, 2)
    pdf = pd.DataFrame({"series_id": 1, "t": np.arange(n), "forward_returns": fr, "risk_free_rate": rf,
                        "position": pos})
    return spark.createDataFrame(pdf), pdf


def test_rolling_matches_pandas(spark):
    df, pdf = _df(spark)
    w = R.series_window()
    got = df.select("t", R.roll_mean("forward_returns", 21, w).alias("m"), R.roll_std("forward_returns", 21, w).alias("s"),
                    R.roll_sum("forward_returns", 21, w, 5).alias("c"), R.roc("forward_returns", 5, w).alias("r")) \
        .toPandas().sort_values("t")
    x = pdf["forward_returns"]
    np.testing.assert_allclose(got["m"].astype(float), x.rolling(21).mean(), rtol=1e-10, atol=1e-14)
    np.testing.assert_allclose(got["s"].astype(float), x.rolling(21).std(), rtol=1e-9, atol=1e-14)
    np.testing.assert_allclose(got["c"].astype(float), x.rolling(21, min_periods=5).sum(), rtol=1e-10, atol=1e-14)
    np.testing.assert_allclose(got["r"].astype(float), x / x.shift(5) - 1, rtol=1e-9)


def _pandas_score(pdf):
    sr = pdf.risk_free_rate * (1 - pdf.position) + pdf.position * pdf.forward_returns
    se = (1 + (sr - pdf.risk_free_rate)).prod() ** (1 / len(pdf)) - 1
    ss = sr.std()
    sharpe = se / ss * math.sqrt(252)
    me = (1 + (pdf.forward_returns - pdf.risk_free_rate)).prod() ** (1 / len(pdf)) - 1
    sm = pdf.forward_returns.std()
    vol_pen = 1 + max(0, (ss * math.sqrt(252) * 100) / (sm * math.sqrt(252) * 100) - 1.2)
    gap = max(0, (me - se) * 100 * 252)
    return min(sharpe / (vol_pen * (1 + gap ** 2 / 100)), 1_000_000)


def test_adjusted_sharpe_matches_reference_formula(spark):
    df, pdf = _df(spark)
    got = S.adjusted_sharpe(df, by="series_id").first()
    assert got["status"] == "ok"
    assert abs(got["adjusted_sharpe"] - _pandas_score(pdf)) < 1e-9


def test_score_status_codes(spark):
    df, _ = _df(spark)
    hi = S.adjusted_sharpe(df.withColumn("position", F.lit(2.0001)), by="series_id").first()
    lo = S.adjusted_sharpe(df.withColumn("position", F.lit(-0.0001)), by="series_id").first()
    nul = S.adjusted_sharpe(df.withColumn("position", F.lit(None).cast("double")), by="series_id").first()
    assert hi["status"] == "position_above_max" and hi["adjusted_sharpe"] is None
    assert lo["status"] == "position_below_min"
    assert nul["status"] == "prediction_not_numeric"


def test_full_market_position_equals_market_return(spark):
    df, pdf = _df(spark)
    one = df.withColumn("position", F.lit(1.0)).select(
        S.strategy_return("position", "forward_returns", "risk_free_rate").alias("s"), "forward_returns").toPandas()
    np.testing.assert_allclose(one["s"], one["forward_returns"], rtol=0, atol=1e-15)


def test_momentum_no_look_ahead(spark):
    df, pdf = _df(spark, n=300)
    df = df.withColumnRenamed("forward_returns", "log_market_forward_excess_returns")
    a = FE.momentum(df).where("t < 200").drop("position").toPandas().sort_values("t").reset_index(drop=True)
    changed = df.withColumn("log_market_forward_excess_returns",
                            F.when(F.col("t") >= 200, F.lit(0.5)).otherwise(F.col("log_market_forward_excess_returns")))
    b = FE.momentum(changed).where("t < 200").drop("position").toPandas().sort_values("t").reset_index(drop=True)
    for c in FE.momentum_names():
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=0)
