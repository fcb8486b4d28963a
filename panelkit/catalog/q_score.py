"""Registered queries: signals and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.catalog import ctes
from panelkit.catalog.spec import register
from panelkit.functions.compat import clip
from panelkit.operators import score as S
from panelkit.operators.rolling import roll_mean, roll_std, series_window, lag
from panelkit.sources import tables as T

SHARPE_OUT = [("series_id", "i"), ("n", "i"), ("adjusted_sharpe", 6), ("sharpe", 6),
              ("strategy_vol", 6), ("market_vol", 6), ("vol_penalty", 6),
              ("return_penalty", 6), ("status", "s")]

_SHARPE_SQL = """,
agg AS (
  SELECT series_id, count(*) AS n, max(position) AS pmax, min(position) AS pmin,
         count(position) AS pn,
         exp(avg(ln(1 + (sr - risk_free_rate)))) - 1 AS se,
         exp(avg(ln(1 + (forward_returns - risk_free_rate)))) - 1 AS me,
         stddev_samp(sr) AS ss, stddev_samp(forward_returns) AS sm
  FROM strat GROUP BY series_id),
pen AS (
  SELECT *, se / nullif(ss, 0) * sqrt(252) AS sharpe,
         1 + greatest(ss / nullif(sm, 0) - 1.2, 0) AS vol_penalty,
         1 + power(greatest((me - se) * 100 * 252, 0), 2) / 100 AS return_penalty,
         CASE WHEN pn < n THEN 'prediction_not_numeric'
              WHEN pmax > 2 THEN 'position_above_max'
              WHEN pmin < 0 THEN 'position_below_min'
              WHEN coalesce(ss, 0) = 0 THEN 'strategy_std_zero'
              WHEN coalesce(sm, 0) = 0 THEN 'market_std_zero' ELSE 'ok' END AS status
  FROM agg)
SELECT series_id, n,
       CASE WHEN status = 'ok' THEN least(sharpe / (vol_penalty * return_penalty), 1000000) END
         AS adjusted_sharpe,
       sharpe, ss * sqrt(252) * 100 AS strategy_vol, sm * sqrt(252) * 100 AS market_vol,
       vol_penalty, return_penalty, status
FROM pen"""


@register("s5_adjusted_sharpe",
          ctes.PANEL + ctes.SCORES + """,
strat AS (SELECT series_id, prediction AS position, forward_returns, risk_free_rate,
                 risk_free_rate * (1 - prediction) + prediction * forward_returns AS sr
          FROM scores)""" + _SHARPE_SQL, SHARPE_OUT)
def s5_adjusted_sharpe(spark, sf_dir):
    """Flagship: predictions from a trailing mean -> positions -> per-series score."""
    sc = T.scores(spark, sf_dir).withColumnRenamed("prediction", "position")
    return S.adjusted_sharpe(sc, by="series_id")


@register("s1_ret_to_signal",
          ctes.PANEL + """
SELECT series_id, t, CASE WHEN r IS NOT NULL THEN least(greatest(400 * r + 1, 0), 2) END AS signal
FROM (SELECT series_id, t, avg(market_forward_excess_returns) OVER (PARTITION BY series_id ORDER BY t
            ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS r FROM panel) x""", [("series_id", "i"), ("t", "date"), ("signal", 6)])
def s1_ret_to_signal(spark, sf_dir):
    p = T.panel(spark, sf_dir)
    w = series_window()
    pred = F.avg("market_forward_excess_returns").over(w.rowsBetween(-5, -1))
    return p.select("series_id", "t", S.ret_to_signal(pred).alias("signal"))


@register("s4_strategy_return",
          ctes.PANEL + ctes.SCORES + """
SELECT series_id, t, risk_free_rate * (1 - prediction) + prediction * forward_returns AS strategy_return,
       risk_free_rate * (1 - prediction) + prediction * forward_returns - risk_free_rate AS excess_return
FROM scores""", [("series_id", "i"), ("t", "date"), ("strategy_return", 8), ("excess_return", 8)])
def s4_strategy_return(spark, sf_dir):
    sc = T.scores(spark, sf_dir)
    sr = S.strategy_return("prediction", "forward_returns", "risk_free_rate")
    return sc.select("series_id", "t", sr.alias("strategy_return"),
                     (sr - F.col("risk_free_rate")).alias("excess_return"))


@register("e1_score_keyed_join",
          ctes.PANEL + ctes.SCORES + """,
strat AS (
  SELECT s.series_id, b.prediction AS position, s.forward_returns, s.risk_free_rate,
         s.risk_free_rate * (1 - b.prediction) + b.prediction * s.forward_returns AS sr
  FROM panel s JOIN scores b ON s.series_id = b.series_id AND s.t = b.t)""" + _SHARPE_SQL,
          SHARPE_OUT)
def e1_score_keyed_join(spark, sf_dir):
    """Solution and submission as two tables joined on the row id (series_id, t)."""
    sol = T.panel(spark, sf_dir).select("series_id", "t", "forward_returns", "risk_free_rate")
    sub = T.scores(spark, sf_dir).select("series_id", "t", "prediction")
    return S.score_submission(sol, sub, row_id=["series_id", "t"], by="series_id")


@register("s6_score_status",
          ctes.PANEL + """,
strat AS (
  SELECT series_id, position, forward_returns, risk_free_rate,
         risk_free_rate * (1 - position) + position * forward_returns AS sr
  FROM (SELECT *, CASE WHEN series_id % 4 = 0 THEN 1.0
                       WHEN series_id % 4 = 1 THEN 2.0 + 100 * forward_returns
                       WHEN series_id % 4 = 2 THEN -100 * forward_returns
                       ELSE 1 + 10 * forward_returns END AS position FROM panel) x)""" + _SHARPE_SQL,
          SHARPE_OUT)
def s6_score_status(spark, sf_dir):
    """Status codes: full-market position, positions above 2, below 0, and valid."""
    p = T.panel(spark, sf_dir)
    m = F.col("series_id") % 4
    fr = F.col("forward_returns")
    pos = (F.when(m == 0, F.lit(1.0)).when(m == 1, 2.0 + 100 * fr)
           .when(m == 2, -100 * fr).otherwise(1 + 10 * fr))
    return S.adjusted_sharpe(p.withColumn("position", pos), by="series_id")


@register("s7_perf_metrics",
          ctes.PANEL + ctes.SCORES + """,
z AS (SELECT series_id, t, least(greatest(prediction, 0), 2) AS p, forward_returns, risk_free_rate
      FROM scores WHERE prediction IS NOT NULL AND forward_returns IS NOT NULL
        AND risk_free_rate IS NOT NULL),
s AS (SELECT *, risk_free_rate * (1 - p) + p * forward_returns AS strat FROM z),
e AS (SELECT *, strat - risk_free_rate AS excess,
             sum(ln(1 + strat)) OVER (PARTITION BY series_id ORDER BY t
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS leq,
             abs(p - lag(p) OVER (PARTITION BY series_id ORDER BY t)) AS dp FROM s),
d AS (SELECT *, exp(leq - max(leq) OVER (PARTITION BY series_id ORDER BY t
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM e),
a AS (SELECT series_id, count(*) AS obs, exp(sum(ln(1 + strat))) - 1 AS total_return,
             date_diff('day', min(t), max(t)) AS days, avg(excess) AS mu, stddev_samp(strat) AS sd,
             stddev_samp(CASE WHEN excess < 0 THEN excess END) AS dsd, min(dd) AS max_drawdown,
             coalesce(sum(dp), 0) / count(*) AS avg_daily_turnover
      FROM d GROUP BY series_id)
SELECT series_id, total_return,
       power(1 + total_return, 1.0 / nullif(days / 365.25, 0)) - 1 AS cagr,
       CASE WHEN sd > 0 THEN mu / sd * sqrt(252) END AS sharpe,
       CASE WHEN dsd > 0 THEN mu * 252 / (dsd * sqrt(252)) END AS sortino,
       max_drawdown, avg_daily_turnover, obs
FROM a""", [("series_id", "i"), ("total_return", 6), ("cagr", 6), ("sharpe", 6), ("sortino", 6),
            ("max_drawdown", 6), ("avg_daily_turnover", 6), ("obs", "i")])
def s7_perf_metrics(spark, sf_dir):
    sc = T.scores(spark, sf_dir).withColumnRenamed("prediction", "position")
    return S.perf_metrics(sc, by="series_id")


@register("s8_cumulative_curves",
          ctes.PANEL + ctes.SCORES + """
SELECT series_id, t,
       exp(sum(ln(1 + market_forward_excess_returns)) OVER w) AS cum_market,
       exp(sum(ln(1 + least(greatest(prediction, 0), 2) * market_forward_excess_returns)) OVER w)
         AS cum_strategy
FROM scores
WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
          [("series_id", "i"), ("t", "date"), ("cum_market", 6), ("cum_strategy", 6)])
def s8_cumulative_curves(spark, sf_dir):
    sc = T.scores(spark, sf_dir).withColumnRenamed("prediction", "position")
    return S.cumulative_curves(sc, by="series_id", ret="market_forward_excess_returns")


@register("s3_vol_factor",
          ctes.PANEL + """,
v AS (SELECT series_id, t, CASE WHEN count(forward_returns) OVER w >= 21
                                THEN stddev_samp(forward_returns) OVER w END AS vol21
      FROM panel
      WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))
SELECT v.series_id, v.t, v.vol21 / nullif(m.med, 0) AS vol_factor
FROM v JOIN (SELECT series_id, median(vol21) AS med FROM v GROUP BY series_id) m
  ON v.series_id = m.series_id""", [("series_id", "i"), ("t", "date"), ("vol_factor", 6)])
def s3_vol_factor(spark, sf_dir):
    p = T.panel(spark, sf_dir)
    v = p.select("series_id", "t", roll_std("forward_returns", 21, series_window()).alias("vol21"))
    return S.vol_factor(v, vol="vol21", by="series_id").select("series_id", "t", "vol_factor")


@register("s2_signal_to_position",
          ctes.PANEL + """,
f AS (SELECT series_id, t, forward_returns AS y,
             avg(forward_returns) OVER (PARTITION BY series_id ORDER BY t
                 ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS y_pred,
             CASE WHEN count(forward_returns) OVER w >= 21 THEN stddev_samp(forward_returns) OVER w END AS vol21,
             CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY t) % 7 = 0 THEN 1 ELSE 0 END AS regime,
             CASE WHEN t < DATE '1998-01-01' THEN 'train' ELSE 'test' END AS role
      FROM panel
      WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
st AS (SELECT series_id, avg(y_pred) AS mu, stddev_pop(y_pred) AS sigma,
              median(vol21) AS med FROM f WHERE role = 'train' GROUP BY series_id),
te AS (SELECT f.*, st.mu, st.sigma, f.vol21 / nullif(st.med, 0) AS vf, 0.5 AS rf
       FROM f LEFT JOIN st ON f.series_id = st.series_id WHERE f.role = 'test'),
pos AS (SELECT series_id, t,
               CASE WHEN sigma IS NOT NULL AND sigma <> 0 AND NOT isnan(sigma)
                    THEN 1 + 0.25 / (1 + 0.5 * vf + 0.5 * rf) * (y_pred - mu) / sigma ELSE 1.0 END
               * CASE WHEN regime = 1 THEN 0.5 ELSE 1.0 END AS raw
        FROM te)
SELECT series_id, t, CASE WHEN raw IS NULL THEN NULL ELSE least(greatest(raw, 0), 2) END AS position
FROM pos""", [("series_id", "i"), ("t", "date"), ("position", 6)])
def s2_signal_to_position(spark, sf_dir):
    """Train/test split by date; z-score on train predictions; regime scaling."""
    p = T.panel(spark, sf_dir)
    w = series_window()
    f = p.select(
        "series_id", "t", F.col("forward_returns").alias("y"),
        F.avg("forward_returns").over(w.rowsBetween(-5, -1)).alias("y_pred"),
        roll_std("forward_returns", 21, w).alias("vol21"),
        F.when(F.row_number().over(w) % 7 == 0, 1).otherwise(0).alias("regime"),
        (F.col("t") < F.lit("1998-01-01").cast("date")).alias("is_train"))
    stats = S.pred_stats(f.where("is_train"), on="series_id")
    vf = S.vol_factor(f, vol="vol21", by="series_id", train_only="is_train")
    te = vf.where(~F.col("is_train")).withColumn("rmse_factor", F.lit(0.5))
    out = S.signal_to_position(te, stats, on="series_id")
    return out.select("series_id", "t", "position")
