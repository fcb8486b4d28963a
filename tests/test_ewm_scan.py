"""EWM (blocked affine scan) and row index / block + halo against pandas and plain windows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, Window

from panelkit.plans import scan
from panelkit.operators import rolling as R


def _frame(spark, seed=0, n=300, series=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(series):
        x = rng.normal(size=n)
        x[rng.random(n) < 0.3] = np.nan
        x[:7] = np.nan
        for i in range(n):
            rows.append((s, i, None if np.isnan(x[i]) else float(x[i])))
    return spark.createDataFrame(rows, "series_id long, t long, x double")


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("block", [16, 1 << 16])
def test_ewm_equals_pandas(spark, adjust, block):
    df = _frame(spark)
    alphas = {"fast": 2 / 11, "slow": 2 / 51, "com": 1 / 1.5}
    got = scan.ewm(df, "x", alphas, adjust=adjust, block_rows=block).toPandas()
    got = got.sort_values(["series_id", "t"]).reset_index(drop=True)
    for s, g in got.groupby("series_id"):
        for n, a in alphas.items():
            ref = g["x"].astype(float).ewm(alpha=a, adjust=adjust).mean().to_numpy()
            val = g[n].astype(float).to_numpy()
            assert np.array_equal(np.isnan(ref), np.isnan(val))
            assert np.nanmax(np.abs(ref - val)) < 1e-12


def test_row_index_and_halo_equal_plain_window(spark):
    df = _frame(spark, seed=1, n=500, series=2)
    w = Window.partitionBy("series_id").orderBy("t")
    plain = df.select("series_id", "t", (F.row_number().over(w) - 1).alias("rn0"),
                      R.roll_mean("x", 21, w, 5).alias("m0"), R.roll_std("x", 21, w, 5).alias("s0"))
    idx = scan.row_index(df, "series_id", "t", out="rn", bucket_span=37)
    blk = scan.rolling_blocked(idx, {"m1": ("mean", "x", 21, 5), "s1": ("std", "x", 21, 5)}, rn="rn",
                               block_rows=64)
    j = plain.join(blk, ["series_id", "t"]).toPandas()
    assert len(j) == 1000
    assert (j["rn0"] == j["rn"]).all()
    for a, b in (("m0", "m1"), ("s0", "s1")):
        x, y = j[a].astype(float).to_numpy(), j[b].astype(float).to_numpy()
        assert np.array_equal(np.isnan(x), np.isnan(y))
        assert np.nanmax(np.abs(x - y)) < 1e-12


def test_blocked_plan_has_no_single_partition(spark):
    df = _frame(spark, seed=2, n=200, series=1)
    idx = scan.row_index(df, "series_id", "t", out="rn", bucket_span=50)
    out = scan.rolling_blocked(idx, {"m": ("mean", "x", 10, 1)}, rn="rn", block_rows=40)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
