"""Series that fit a block are worked out where their rows lie, and give what the block path gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from panelkit.operators import features as FE
from panelkit.plans import scan

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def frame(spark, n=400):
    """Series 1, 2 and one without a key, of which the first is long; NULL values, and rows without a time."""
    rng = np.random.default_rng(11)
    rows = [(s, t, None if rng.random() < 0.1 else float(rng.normal()), float(rng.normal()) / 100)
            for s, size in ((1, n), (2, 30), (None, 60)) for t in range(size)]
    rows += [(1, None, 5.0, 0.01), (1, None, 6.0, 0.02), (None, None, 7.0, 0.03)]
    return spark.createDataFrame(rows, "series_id long, t int, A double, market_forward_excess_returns double")


def table(df, by):
    return df.toPandas().sort_values(by, na_position="last").reset_index(drop=True)


def test_extension_moves_the_rows_once(spark):
    assert exchanges(E.queries()["p4_extend_long"](spark, SF)) == 1


def test_pipeline_moves_nothing_after_its_rows_are_written(spark):
    assert exchanges(E.queries()["panel_pipeline"](spark, SF)) == 0


def test_short_pass_is_block_pass(spark):
    df = frame(spark)
    outs = {**scan.shifted_stats("A", (5, 63), (1, 21), 3, ewms={"e": 0.2}), "c": scan.Stat("corr", "A", 21, 5, other="market_forward_excess_returns"),
            "f": scan.Ewm("A", 0.3, adjust=True)}
    by = ["series_id", "t", "A"]
    short, blocks = (table(scan.series_pass(df, outs, block_rows=b), by) for b in (scan.DEFAULT_BLOCK_ROWS, 100))
    assert len(short) == df.count() and list(short.columns) == list(blocks.columns)
    pd.testing.assert_frame_equal(short, blocks, rtol=1e-9, atol=1e-12)
    assert short[short.t.isna()][list(outs)].isna().all().all()


def test_short_pass_over_many_batches_and_calls(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=25_000)  # over two Arrow batches
    df = spark.createDataFrame(pd.DataFrame({"series_id": np.r_[np.zeros(24_000), np.ones(1_000)].astype(int), "t": np.r_[:24_000, :1_000], "x": x}))
    monkeypatch.setattr(scan, "WIDEST", 2)
    got = table(scan.series_pass(df, {f"m{k}": scan.Stat("mean", "x", k, 1) for k in (2, 3, 4, 5, 6)}), ["series_id", "t"])
    for k in (2, 3, 4, 5, 6):
        want = np.r_[pd.Series(x[:24_000]).rolling(k, 1).mean(), pd.Series(x[24_000:]).rolling(k, 1).mean()]
        assert np.allclose(got[f"m{k}"], want)


def test_filter_does_not_reach_the_windows(spark):
    df = frame(spark)
    outs = {"m": scan.Stat("mean", "A", 5, 1)}
    whole = table(scan.series_pass(df, outs), ["series_id", "t"])
    some = table(scan.series_pass(df, outs).where("t >= 20"), ["series_id", "t"])
    pd.testing.assert_frame_equal(some, whole[whole.t >= 20].reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("fill", [None, FE.SENTINEL])
def test_wide_extension_is_long_extension(spark, fill):
    df = frame(spark).where("t is not null").withColumn("B", F.col("A") * 2 + 1)
    d = FE.target_log(df, out="y")
    wide = FE.momentum_volatility(d, "y", extend=["A", "B"], extend_fill=fill)
    source = df if fill is None else df.fillna(fill, ["A", "B"])
    long = FE.to_wide(FE.extend_long(FE.to_long(source, ["A", "B"])), ["A", "B"], FE.extension_names())
    names = [f"{c}_{s}" for c in "AB" for s in FE.extension_names()]
    by = ["series_id", "t"]
    pd.testing.assert_frame_equal(table(wide, by)[by + names], table(long, by)[by + names])
    without = FE.momentum_volatility(d, "y")
    pd.testing.assert_frame_equal(table(wide, by)[without.columns], table(without, by))


def test_pipeline_in_blocks_is_pipeline(spark):
    from panelkit.plans import pipeline as PL
    df = frame(spark)
    by = ["series_id", "t", "A"]
    # the flags of two windows that are equal but for rounding may differ, so they are left out
    short, blocks = (table(PL.panel_pipeline(df, block_rows=b), by) for b in (scan.DEFAULT_BLOCK_ROWS, 300))
    assert len(short) == df.count() and list(short.columns) == list(blocks.columns)
    names = [c for c in short if not c.startswith("VI_")]
    pd.testing.assert_frame_equal(short[names], blocks[names], rtol=1e-6, atol=1e-9)


def test_guards_and_fill(spark):
    df = spark.createDataFrame([(1, 1, float("inf"), 1.0, 3), (1, 2, None, 1.0, 4), (1, 3, float("nan"), 1.0, 5)],
                               "series_id int, t int, a double, b double, c int")
    got = FE.guard_wide(df)
    assert got.columns == ["series_id", "t", "c"]  # a is all filled, b constant
    from panelkit.functions.compat import sentinel
    s = df.select(sentinel("a", -1.0).alias("a"), sentinel("c", -1.0).alias("c"))
    assert [tuple(r) for r in s.collect()] == [(-1.0, 3.0), (-1.0, 4.0), (-1.0, 5.0)]
    assert not s.schema["a"].nullable  # filled columns need no count of NULLs
