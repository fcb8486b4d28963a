"""Registered queries: window / time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.catalog import ctes
from panelkit.catalog import sqlgen as G
from panelkit.catalog.spec import register
from panelkit.functions.compat import flag, safe_div
from panelkit.operators import rolling as R
from panelkit.operators.quantiles import median
from panelkit.plans import scan
from panelkit.sources import tables as T

WINDOWS = [5, 10, 21, 63, 126, 252]
LAGS = [1, 2, 3, 5, 10, 21, 63, 126]
KEY = [("series_id", "i"), ("t", "date")]


@register("w1_lag",
          ctes.PANEL + "\nSELECT series_id, t, "
          + ", ".join(f"{G.lag('px', n)} AS px_lag_{n}" for n in LAGS) + " FROM panel",
          KEY + [(f"px_lag_{n}", 6) for n in LAGS])
def w1_lag(spark, sf_dir):
    p = T.panel(spark, sf_dir)
    return R.lags(p, "px", LAGS).select("series_id", "t", *[f"px_lag_{n}" for n in LAGS])


def _roll_query(stat, sql_stat, digits):
    cols = [f"fr_{stat}_{k}" for k in WINDOWS]
    sql = (ctes.PANEL + "\nSELECT series_id, t, "
           + ", ".join(f"{G.roll(sql_stat, 'forward_returns', k)} AS fr_{stat}_{k}" for k in WINDOWS)
           + " FROM panel")

    def build(spark, sf_dir):
        p = T.panel(spark, sf_dir)
        return R.rolling(p, "forward_returns", WINDOWS, [stat], prefix="fr").select(
            "series_id", "t", *cols)
    return sql, KEY + [(c, digits) for c in cols], build


for _id, _stat, _sql in [("w2_rolling_mean", "mean", "avg"), ("w3_rolling_std", "std", "stddev_samp"),
                         ("w4_rolling_sum", "sum", "sum")]:
    _s, _o, _b = _roll_query(_stat, _sql, 8)
    register(_id, _s, _o)(_b)


@register("w2_rolling_min_periods",
          ctes.PANEL + ctes.GAPS + "\nSELECT series_id, t, "
          + ", ".join(f"{G.roll('avg', 'E1', k, 5)} AS e1_mean_{k}, {G.roll('stddev_samp', 'E1', k, 5)} AS e1_std_{k}"
                      for k in (21, 63)) + " FROM panel_gaps",
          KEY + [(f"e1_{s}_{k}", 6) for k in (21, 63) for s in ("mean", "std")])
def w2_rolling_min_periods(spark, sf_dir):
    """Rolling mean/std with min_periods=5 over a column with scattered gaps."""
    g = T.panel_gaps(spark, sf_dir).select("series_id", "t", "E1")
    return R.rolling(g, "E1", (21, 63), ("mean", "std"), 5, prefix="e1").drop("E1")


@register("w5_rate_of_change",
          ctes.PANEL + ctes.GAPS + "\nSELECT series_id, t, "
          + ", ".join(f"{G.sdiv('V1', G.lag('V1', k))} - 1 AS v1_roc_{k}" for k in (1, 5, 21))
          + " FROM panel_gaps",
          KEY + [(f"v1_roc_{k}", 6) for k in (1, 5, 21)])
def w5_rate_of_change(spark, sf_dir):
    """x / lag(x, k) - 1 over a column that contains zeros (zero base -> NULL)."""
    g = T.panel_gaps(spark, sf_dir)
    w = R.series_window()
    return g.select("series_id", "t", *[R.roc("V1", k, w).alias(f"v1_roc_{k}") for k in (1, 5, 21)])


@register("w9_vol_ratio",
          ctes.PANEL + f"""
SELECT series_id, t, {G.sdiv(G.roll('stddev_samp', 'forward_returns', 21), G.roll('stddev_samp', 'forward_returns', 252))} AS std_21_252_ratio
FROM panel""", KEY + [("std_21_252_ratio", 6)])
def w9_vol_ratio(spark, sf_dir):
    p = T.panel(spark, sf_dir)
    s = R.rolling(p.select("series_id", "t", "forward_returns"), "forward_returns", (21, 252), ("std",), prefix="s")
    return s.select("series_id", "t", safe_div("s_std_21", "s_std_252").alias("std_21_252_ratio"))


@register("w10_pct_change",
          ctes.PANEL + f"""
SELECT series_id, t, coalesce({G.sdiv('px', G.lag('px', 1))} - 1, 0) AS px_pct_change FROM panel""",
          KEY + [("px_pct_change", 8)])
def w10_pct_change(spark, sf_dir):
    p = T.panel(spark, sf_dir)
    return p.select("series_id", "t", R.pct_change("px", R.series_window()).alias("px_pct_change"))


@register("w11_cumprod",
          ctes.PANEL + f"""
SELECT series_id, t, product(1 + forward_returns) OVER {G.win()} AS wealth FROM panel""",
          KEY + [("wealth", 6)])
def w11_cumprod(spark, sf_dir):
    p = T.panel(spark, sf_dir)
    return scan.carry(p, {"wealth": ("product", 1 + F.col("forward_returns"))}).select("series_id", "t", "wealth")


@register("w12_drawdown",
          ctes.PANEL + f""",
eq AS (SELECT series_id, t, product(1 + forward_returns) OVER {G.win()} AS wealth FROM panel),
dd AS (SELECT *, max(wealth) OVER {G.win()} AS peak FROM eq)
SELECT series_id, t, wealth, peak, wealth / peak - 1 AS drawdown,
       min(wealth / peak - 1) OVER (PARTITION BY series_id) AS max_drawdown
FROM dd""", KEY + [("wealth", 6), ("peak", 6), ("drawdown", 6), ("max_drawdown", 6)])
def w12_drawdown(spark, sf_dir):
    p = T.panel(spark, sf_dir)
    e = scan.carry(p.select("series_id", "t", "forward_returns"), {"wealth": ("product", 1 + F.col("forward_returns"))},
                   {"peak": ("max", "wealth")}).withColumn("drawdown", safe_div("wealth", "peak") - 1)
    return R.attach(e, e.groupBy("series_id").agg(F.min("drawdown").alias("max_drawdown")), "series_id")


@register("w13_turnover",
          ctes.PANEL + ctes.SCORES + """
SELECT series_id, sum(coalesce(dp, 0)) / count(*) AS avg_daily_turnover, count(*) AS n
FROM (SELECT series_id, abs(prediction - lag(prediction) OVER (PARTITION BY series_id ORDER BY t)) AS dp
      FROM scores) x GROUP BY series_id""",
          [("series_id", "i"), ("avg_daily_turnover", 8), ("n", "i")])
def w13_turnover(spark, sf_dir):
    s = T.scores(spark, sf_dir)
    w = R.series_window()
    d = s.select("series_id", F.abs(R.diff("prediction", w)).alias("dp"))
    return d.groupBy("series_id").agg(
        (F.sum(F.coalesce("dp", F.lit(0.0))) / F.count(F.lit(1))).alias("avg_daily_turnover"),
        F.count(F.lit(1)).alias("n"))


@register("w14_trend_regime",
          ctes.PANEL + f""",
m AS (SELECT series_id, t, product(1 + forward_returns) OVER {G.win()} AS mkt FROM panel)
SELECT series_id, t, CASE WHEN mkt > {G.roll('avg', 'mkt', 200)} THEN 1 ELSE 0 END AS bull FROM m""",
          KEY + [("bull", "i")])
def w14_trend_regime(spark, sf_dir):
    """Wealth curve above its 200-row moving average (NULL -> 0)."""
    p = T.panel(spark, sf_dir)
    m = scan.carry(p.select("series_id", "t", "forward_returns"), {"mkt": ("product", 1 + F.col("forward_returns"))})
    m = scan.series_pass(m, {"sma": scan.Stat("mean", "mkt", 200)})
    return m.select("series_id", "t", flag(F.col("mkt") > F.col("sma")).alias("bull"))


@register("w15_shock_zscore",
          ctes.PANEL + f""",
s AS (SELECT series_id, t, forward_returns AS x, {G.lag('forward_returns', 1)} AS x1 FROM panel),
z AS (SELECT *, {G.roll('stddev_samp', 'x1', 21)} AS sd FROM s)
SELECT series_id, t, {G.sdiv('x', 'sd')} AS z,
       CASE WHEN abs(x) > 2.5 * sd THEN 1 ELSE 0 END AS shock FROM z""",
          KEY + [("z", 6), ("shock", "i")])
def w15_shock_zscore(spark, sf_dir):
    """z = x / std21(lag x); shock = |z| > 2.5 (std 0 with x != 0 counts as a shock)."""
    p = T.panel(spark, sf_dir)
    s = scan.series_pass(p.select("series_id", "t", F.col("forward_returns").alias("x")),
                         {"sd": scan.Stat("std", "x", 21, shift=1)})
    return s.select("series_id", "t", safe_div("x", "sd").alias("z"),
                    flag(F.abs("x") > 2.5 * F.col("sd")).alias("shock"))


@register("w16_bfill_ffill",
          ctes.PANEL + ctes.GAPS + "\nSELECT series_id, t, "
          + ", ".join(
              f"coalesce(first_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t "
              f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
              f"last_value({c} IGNORE NULLS) OVER {G.win()}) AS {c.lower()}_filled"
              for c in ("P1", "E1", "M1")) + " FROM panel_gaps",
          KEY + [("p1_filled", 6), ("e1_filled", 6), ("m1_filled", 6)])
def w16_bfill_ffill(spark, sf_dir):
    g, names = T.panel_gaps(spark, sf_dir), ("P1", "E1", "M1")
    f = scan.carry(g, {f"{k}_{c}": (k, c) for c in names for k in ("next", "last")})
    return f.select("series_id", "t", *[F.coalesce(f"next_{c}", f"last_{c}").alias(f"{c.lower()}_filled") for c in names])


_ERR = ctes.PANEL + ctes.SCORES + """,
e AS (SELECT series_id, t, forward_returns AS y, 0.01 * (prediction - 1) AS yhat FROM scores)"""


@register("w17_rolling_corr",
          _ERR + f"""
SELECT series_id, t,
       CASE WHEN count(CASE WHEN y IS NOT NULL AND yhat IS NOT NULL THEN 1 END) OVER {G.win(126)} >= 126
            THEN {G.fin(f'corr(y, yhat) OVER {G.win(126)}')} END AS roll_corr
FROM e""", KEY + [("roll_corr", 6)])
def w17_rolling_corr(spark, sf_dir):
    e = _err(spark, sf_dir)
    return scan.series_pass(e, {"roll_corr": scan.Stat("corr", "y", 126, other="yhat")}).drop("y", "yhat")


def _err(spark, sf_dir):
    s = T.scores(spark, sf_dir)
    return s.select("series_id", "t", F.col("forward_returns").alias("y"),
                    (0.01 * (F.col("prediction") - 1)).alias("yhat"))


@register("w18_rolling_rmse",
          _ERR + f"""
SELECT series_id, t, sqrt({G.roll('avg', '(y - yhat) * (y - yhat)', 126)}) AS roll_rmse FROM e""",
          KEY + [("roll_rmse", 8)])
def w18_rolling_rmse(spark, sf_dir):
    e = _err(spark, sf_dir)
    e = e.withColumn("e2", F.pow(F.col("y") - F.col("yhat"), 2))
    return scan.series_pass(e, {"mse": scan.Stat("mean", "e2", 126)}).select("series_id", "t", F.sqrt("mse").alias("roll_rmse"))


@register("w19_directional_accuracy",
          _ERR + f""",
h AS (SELECT *, CAST(sign(y) = sign(yhat) AS INTEGER) AS hit FROM e)
SELECT series_id, t, {G.roll('avg', 'hit', 252)} AS rolling_acc FROM h""",
          KEY + [("rolling_acc", 6)])
def w19_directional_accuracy(spark, sf_dir):
    e = _err(spark, sf_dir)
    h = e.withColumn("hit", R.directional_hit("y", "yhat"))
    return scan.series_pass(h, {"rolling_acc": scan.Stat("mean", "hit", 252)}).select("series_id", "t", "rolling_acc")


@register("w20_smoothed",
          _ERR + f"""
SELECT series_id, t, {G.roll('avg', 'y', 21)} AS y_ma21, {G.roll('avg', 'yhat', 21)} AS yhat_ma21 FROM e""",
          KEY + [("y_ma21", 8), ("yhat_ma21", 8)])
def w20_smoothed(spark, sf_dir):
    e = _err(spark, sf_dir)
    return scan.series_pass(e, {f"{c}_ma21": scan.Stat("mean", c, 21) for c in ("y", "yhat")}).drop("y", "yhat")


@register("w22_row_number",
          ctes.PANEL + """
SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS rn FROM panel""",
          KEY + [("rn", "i")])
def w22_row_number(spark, sf_dir):
    p = T.panel(spark, sf_dir)
    return p.select("series_id", "t", R.row_index(R.series_window()).alias("rn"))


@register("w23_winsorised_excess",
          ctes.PANEL + f""",
x AS (SELECT series_id, t, forward_returns - {G.roll('avg', 'forward_returns', 1260, 1)} AS ex FROM panel),
m AS (SELECT series_id, median(ex) AS med FROM x GROUP BY series_id),
d AS (SELECT x.series_id, median(abs(x.ex - m.med)) AS mad FROM x JOIN m USING (series_id)
      GROUP BY x.series_id)
SELECT x.series_id, x.t,
       CASE WHEN x.ex IS NULL THEN NULL
            ELSE least(greatest(x.ex, m.med - 4 * d.mad), m.med + 4 * d.mad) END AS target
FROM x JOIN m USING (series_id) JOIN d USING (series_id)""",
          KEY + [("target", 8)])
def w23_winsorised_excess(spark, sf_dir):
    """Return minus its trailing 5-year mean, clipped to median +- 4 MAD per series."""
    p = scan.series_pass(T.panel(spark, sf_dir).select("series_id", "t", "forward_returns"),
                         {"mean": scan.Stat("mean", "forward_returns", 1260, 1)})
    x = p.select("series_id", "t", (F.col("forward_returns") - F.col("mean")).alias("ex"))
    x = R.attach(x, median(x, "ex", "series_id", "med"), "series_id").withColumn("off", F.abs(F.col("ex") - F.col("med")))
    x = R.attach(x, median(x, "off", "series_id", "mad"), "series_id")
    lo, hi = F.col("med") - 4 * F.col("mad"), F.col("med") + 4 * F.col("mad")
    tgt = F.when(F.col("ex").isNull(), None).otherwise(F.least(F.greatest("ex", lo), hi))
    return x.select("series_id", "t", tgt.alias("target"))
