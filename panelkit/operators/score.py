"""Signals, positions and scoring.

All scores are grouped aggregates: ``by`` names the grouping keys (series,
fold, model ...), so thousands of strategies are scored in one pass with a
partial (map-side) aggregation.  Geometric means use sums of ``log|1 + r|`` with
counts of the factors at and below zero, which equals the reference's
``prod(1 + r) ** (1/n)`` without overflow or underflow on long series.  Running
products and peaks are scans over blocks (``scan.carry``), so one long series
spreads over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.compat import ColumnOrName, clip, col, finite, hinge, cap, safe_div
from panelkit.operators.quantiles import median
from panelkit.operators.rolling import Keys, _keys, attach
from panelkit.plans import scan

# Fixed values of the contest metric (must equal the reference's)
MIN_INVESTMENT = 0.0
MAX_INVESTMENT = 2.0
TRADING_DAYS = 252
VOL_LIMIT = 1.2          # allowed strategy / market volatility ratio
SCORE_CAP = 1_000_000.0
SIGNAL_MULTIPLIER = 400.0


def ret_to_signal(ret: ColumnOrName, multiplier: float = SIGNAL_MULTIPLIER,
                  lo: float = MIN_INVESTMENT, hi: float = MAX_INVESTMENT) -> Column:
    """clip(multiplier * r + 1, lo, hi)."""
    return clip(col(ret) * F.lit(float(multiplier)) + 1, lo, hi)


def strategy_return(position: ColumnOrName, fwd: ColumnOrName, rf: ColumnOrName) -> Column:
    """rf * (1 - p) + p * fr."""
    p, fr, r = col(position), col(fwd), col(rf)
    return r * (1 - p) + p * fr


def _growth(r: ColumnOrName) -> tuple[Column, Column, Column]:
    """log|1 + r| (NULL at r = -1), and flags for r = -1 and r < -1."""
    r = col(r)
    log = F.when(r > -1, F.log1p(r)).when(r < -1, F.log(-(1 + r)))
    return log, (r == -1).cast("int"), (r < -1).cast("int")


def _product(logs: Column, zeros: Column, negatives: Column) -> tuple[Column, Column]:
    """Sign (0 if a factor is 0) and log of the absolute product, from sums."""
    sign = F.when(F.coalesce(zeros, F.lit(0)) > 0, 0).when(F.coalesce(negatives, F.lit(0)) % 2 == 1, -1).otherwise(1)
    return sign, F.coalesce(logs, F.lit(0.0))


def geo_mean(r: ColumnOrName) -> Column:
    """Aggregate: (prod(1 + r)) ** (1/n) - 1 (F18), from sums of logs.

    ``n`` counts all rows, NULL returns are factors of 1; a factor of 0 gives
    -1, a negative product has no real root (NULL) unless n is 1.
    """
    log, zero, neg = _growth(r)
    sign, total = _product(F.sum(log), F.sum(zero), F.sum(neg))
    n = F.count(F.lit(1))
    return finite(F.when(sign == 0, F.lit(-1.0)).when(sign == 1, F.expm1(total / n))
                  .when(n == 1, -F.exp(total) - 1))


def total_return(r: ColumnOrName) -> Column:
    """Aggregate: prod(1 + r) - 1 (F18); factors of 0 and below included."""
    log, zero, neg = _growth(r)
    sign, total = _product(F.sum(log), F.sum(zero), F.sum(neg))
    return finite(F.when(sign == 1, F.expm1(total)).otherwise(sign * F.exp(total) - 1))


def running_product(r: ColumnOrName, name: str) -> tuple[dict, Column, Column]:
    """Running sums for ``scan.carry``, and from them the sign and log of |prod(1 + r)| up to each row."""
    parts = dict(zip((f"{name}_l", f"{name}_z", f"{name}_n"), _growth(r)))
    return {n: ("sum", c) for n, c in parts.items()}, *_product(*map(F.col, parts))


def adjusted_sharpe(df: DataFrame, by: Keys = (), position: str = "position",
                    fwd: str = "forward_returns", rf: str = "risk_free_rate") -> DataFrame:
    """Volatility- and return-penalised Sharpe ratio per group.

    Output: ``by`` keys, ``n``, ``adjusted_sharpe`` (NULL unless ``status`` is
    'ok'), ``sharpe``, ``strategy_vol``, ``market_vol``, ``vol_penalty``,
    ``return_penalty`` and ``status``.
    """
    ks = _keys(by)
    sr = strategy_return(position, fwd, rf)
    s = df.select(*ks, col(position).cast("double").alias("_p"), sr.alias("_sr"),
                  col(fwd).alias("_fr"), col(rf).alias("_rf"))
    a = s.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_p").alias("_pmax"), F.min("_p").alias("_pmin"),
        F.count("_p").alias("_pn"),
        geo_mean(F.col("_sr") - F.col("_rf")).alias("_se"),
        geo_mean(F.col("_fr") - F.col("_rf")).alias("_me"),
        F.stddev_samp("_sr").alias("_ss"), F.stddev_samp("_fr").alias("_sm"))
    ann = math.sqrt(TRADING_DAYS)
    status = (F.when(F.col("_pn") < F.col("n"), "prediction_not_numeric")
              .when(F.col("_pmax") > MAX_INVESTMENT, "position_above_max")
              .when(F.col("_pmin") < MIN_INVESTMENT, "position_below_min")
              .when(F.coalesce(F.col("_ss"), F.lit(0.0)) == 0, "strategy_std_zero")
              .when(F.coalesce(F.col("_sm"), F.lit(0.0)) == 0, "market_std_zero")
              .when(F.col("_se").isNull(), "strategy_product_negative")
              .when(F.col("_me").isNull(), "market_product_negative")
              .otherwise("ok"))
    sharpe = safe_div(F.col("_se"), F.col("_ss")) * ann
    vol_pen = 1 + hinge(safe_div(F.col("_ss"), F.col("_sm")) - VOL_LIMIT)
    gap = hinge((F.col("_me") - F.col("_se")) * 100 * TRADING_DAYS)
    ret_pen = 1 + gap * gap / 100
    adj = cap(safe_div(sharpe, vol_pen * ret_pen), SCORE_CAP)
    return a.select(
        *ks, "n",
        F.when(status == "ok", adj).alias("adjusted_sharpe"),
        sharpe.alias("sharpe"),
        (F.col("_ss") * ann * 100).alias("strategy_vol"),
        (F.col("_sm") * ann * 100).alias("market_vol"),
        vol_pen.alias("vol_penalty"), ret_pen.alias("return_penalty"),
        status.alias("status"))


def score_submission(solution: DataFrame, submission: DataFrame, row_id: Keys,
                     by: Keys = ()) -> DataFrame:
    """Keyed form of the contest score: inner join on the row id, then S5."""
    ids = _keys(row_id)
    j = solution.join(submission.select(*ids, *[c for c in _keys(by) if c not in ids
                                                 and c not in solution.columns],
                                        F.col("prediction").alias("position")), ids, "inner")
    return adjusted_sharpe(j, by)


def perf_metrics(df: DataFrame, by: Keys = (), order: str = "t", position: str = "position",
                 fwd: str = "forward_returns", rf: str = "risk_free_rate") -> DataFrame:
    """Total return, CAGR, Sharpe, Sortino, max drawdown, turnover, obs.

    Rows with any NULL among the inputs are dropped first (as the reference's
    dropna after the join); NULL keys are one group.  Two scans over blocks (equity and
    position change, then peaks) on one exchange, then one grouped aggregate.
    """
    ks = _keys(by)
    z = df.select(*ks, order, position, fwd, rf).dropna(subset=[order, position, fwd, rf])
    p = clip(position, MIN_INVESTMENT, MAX_INVESTMENT)
    z = z.withColumn("_p", p).withColumn("_s", strategy_return("_p", fwd, rf))
    sums, sign, logeq = running_product("_s", "_r")
    # drawdown from log-equity: eq / cummax(eq) - 1 = exp(leq - cummax(leq)) - 1;
    # a ruined strategy (equity 0 or below) falls against its last positive peak
    eq = sign * F.exp(logeq)
    z = scan.carry(z, {**sums, "_pv": ("lag", "_p")}, {"_pk": ("max", F.when(sign == 1, logeq)), "_top": ("max", eq)},
                   keys=ks, order=order)
    fall = logeq - F.col("_pk")
    z = (z.withColumn("_x", F.col("_s") - F.col(rf)).withColumn("_dp", F.abs(F.col("_p") - F.col("_pv")))
         .withColumn("_dd", F.when(F.col("_pk").isNull(), safe_div(eq, F.col("_top")) - 1)
                     .when(sign == 1, F.expm1(fall)).otherwise(sign * F.exp(fall) - 1)))
    a = z.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("obs"),
        total_return("_s").alias("total_return"),
        F.datediff(F.max(order), F.min(order)).alias("_days"),
        F.avg("_x").alias("_mu"), F.stddev_samp("_s").alias("_sd"),
        F.stddev_samp(F.when(F.col("_x") < 0, F.col("_x"))).alias("_dsd"),
        F.min("_dd").alias("max_drawdown"),
        (F.coalesce(F.sum("_dp"), F.lit(0.0)) / F.count(F.lit(1))).alias("avg_daily_turnover"))
    years = F.col("_days") / 365.25
    cagr = finite(F.pow(1 + F.col("total_return"), safe_div(F.lit(1.0), years)) - 1)
    sharpe = F.when(F.col("_sd") > 0, F.col("_mu") / F.col("_sd") * math.sqrt(TRADING_DAYS))
    sortino = F.when(F.col("_dsd") > 0, F.col("_mu") * TRADING_DAYS
                     / (F.col("_dsd") * math.sqrt(TRADING_DAYS)))
    return a.select(*ks, "total_return", cagr.alias("cagr"), sharpe.alias("sharpe"),
                    sortino.alias("sortino"), "max_drawdown", "avg_daily_turnover", "obs")


def cumulative_curves(df: DataFrame, by: Keys = (), order: str = "t", position: str = "position",
                      ret: str = "y_arith") -> DataFrame:
    """Growth of one unit for the market and for position x excess return."""
    ks = _keys(by)
    p = clip(position, MIN_INVESTMENT, MAX_INVESTMENT)
    market, ms, ml = running_product(ret, "_m")
    own, ss, sl = running_product(p * col(ret), "_w")
    z = scan.carry(df.select(*ks, order, position, ret), {**market, **own}, keys=ks, order=order)
    return z.select(*ks, order, (ms * F.exp(ml)).alias("cum_market"), (ss * F.exp(sl)).alias("cum_strategy"))


def signal_to_position(test: DataFrame, train_pred_stats: DataFrame, on: Keys,
                       pred: str = "y_pred", vol_factor: str = "vol_factor",
                       rmse_factor: str = "rmse_factor", regime: str | None = "regime",
                       bad_regime_scale: float = 0.5) -> DataFrame:
    """Map predictions to positions in [0, 2].

    ``train_pred_stats`` carries ``mu`` and population ``sigma`` of the train
    predictions per ``on`` group (one small row per group).
    """
    ks = _keys(on)
    t = attach(test, train_pred_stats.select(*ks, "mu", "sigma"), ks)
    beta = F.lit(0.25) / (1 + 0.5 * col(vol_factor) + 0.5 * col(rmse_factor))
    ok = (F.col("sigma") != 0) & ~F.isnan("sigma") & F.col("sigma").isNotNull()
    z = (col(pred) - F.col("mu")) / F.col("sigma")
    pos = F.when(ok, 1 + beta * z).otherwise(F.lit(1.0))
    if regime is not None:
        pos = pos * F.when(col(regime).cast("int") == 1, F.lit(bad_regime_scale)).otherwise(1.0)
    return t.withColumn("position", clip(pos, MIN_INVESTMENT, MAX_INVESTMENT)).drop("mu", "sigma")


def pred_stats(train: DataFrame, on: Keys, pred: str = "y_pred") -> DataFrame:
    """mean and population std of train predictions per group (input of S2)."""
    return train.groupBy(*_keys(on)).agg(F.avg(pred).alias("mu"),
                                         F.stddev_pop(pred).alias("sigma"))


def vol_factor(df: DataFrame, vol: str = "MOM_std_21", by: Keys = (),
               train_only: str | None = None) -> DataFrame:
    """vol / median(vol) per group (S3).  ``train_only`` names a boolean column
    restricting the median to train rows (no look-ahead)."""
    ks = _keys(by)
    src = df if train_only is None else df.where(F.col(train_only))
    out = attach(df, median(src, vol, ks, "_med"), ks)
    return out.withColumn("vol_factor", safe_div(vol, "_med")).drop("_med")


def ic_by(df: DataFrame, by: Keys, y: str = "y_arith", yhat: str = "y_pred_arith") -> DataFrame:
    """Per-group information coefficient corr(y, yhat)."""
    return df.groupBy(*_keys(by)).agg(finite(F.corr(y, yhat)).alias("ic"))


def regression_metrics(df: DataFrame, by: Keys, y: str = "y", yhat: str = "y_pred") -> DataFrame:
    """R^2 = 1 - SSE/SST, MSE, RMSE, MAE per group."""
    e = col(y) - col(yhat)
    a = df.groupBy(*_keys(by)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_sse"), F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"), (F.var_pop(y) * F.count(y)).alias("_sst"))
    return a.select(*_keys(by), "n", (1 - safe_div("_sse", "_sst")).alias("r2"), "mse",
                    F.sqrt("mse").alias("rmse"), "mae")
