"""Registered queries on the edges: NULL keys and times, short series, ruin, large offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.catalog import ctes
from panelkit.catalog import sqlgen as G
from panelkit.catalog.q_features import _example_src
from panelkit.catalog.q_score import SHARPE_OUT
from panelkit.catalog.spec import REGISTRY, register
from panelkit.functions import calendar as CAL
from panelkit.operators import features as FE
from panelkit.operators import folds as FO
from panelkit.operators import linear as LI
from panelkit.operators import order as OR
from panelkit.operators import profile as PR
from panelkit.operators import score as S
from panelkit.plans import scan
from panelkit.sources import io as IO
from panelkit.sources import tables as T
from panelkit.streaming import stream as ST

KEY = [("series_id", "i"), ("t", "date")]

_NULL_KEY_SQL = ctes.PANEL + """,
holes AS (SELECT CASE WHEN series_id <> 3 THEN series_id END AS series_id,
                 CASE WHEN day(t) <> 7 THEN t END AS t, qty FROM panel)"""


def _null_key(spark, sf_dir):
    """The whole panel, with the key of series 3 and every 7th of a month's time set to NULL."""
    return T.panel(spark, sf_dir).select(F.when(F.col("series_id") != 3, F.col("series_id")).alias("series_id"),
                                         F.when(F.dayofmonth("t") != 7, F.col("t")).alias("t"), "qty")


@register("w22_row_number_null_key", _NULL_KEY_SQL + """
SELECT series_id, t, qty, CASE WHEN t IS NOT NULL THEN row_number() OVER (PARTITION BY series_id, t IS NULL ORDER BY t) - 1 END
       AS rn FROM holes""", KEY + [("qty", 6), ("rn", "i")])
def w22_row_number_null_key(spark, sf_dir):
    """No row is lost: NULL keys are one series, rows without a time have no position."""
    return scan.row_index(_null_key(spark, sf_dir), "series_id", "t", out="rn")


@register("w6_ewm_null_key", G.recursive(_NULL_KEY_SQL + """,
placed AS (SELECT coalesce(series_id, -1) AS series_id, t, CAST(qty AS DOUBLE) AS qty FROM holes WHERE t IS NOT NULL)"""
          + G.ewm_ctes("placed", "qty", {"ema": scan.alpha_of(span=10)}) + """
SELECT CASE WHEN series_id >= 0 THEN series_id END AS series_id, t, ema FROM ewm
UNION ALL SELECT series_id, t, NULL FROM holes WHERE t IS NULL"""), KEY + [("ema", 6)])
def w6_ewm_null_key(spark, sf_dir):
    """EWM over a series with a NULL key; rows without a time keep their place in the output."""
    h = _null_key(spark, sf_dir).withColumn("qty", F.col("qty").cast("double"))
    return scan.ewm(h, "qty", {"ema": scan.alpha_of(span=10)}, block_rows=128).select("series_id", "t", "ema")


@register("v1_fold_status", ctes.PANEL + """,
c AS (SELECT series_id, count(*) AS n FROM panel GROUP BY series_id),
f AS (SELECT series_id, n, i + 1 AS fold, n - (8 - i) * 60 - 1 AS train_hi FROM c, range(0, 8) r(i))
SELECT series_id, fold, CASE WHEN n <= 480 THEN 'too_short'
       WHEN train_hi - greatest(least(floor(train_hi / 5), 252), 50) <= 0 THEN 'no_fit_rows' ELSE 'ok' END AS status
FROM f""", [("series_id", "i"), ("fold", "i"), ("status", "s")])
def v1_fold_status(spark, sf_dir):
    """Every (series, fold) has a status: series too short, folds without fit rows."""
    counts = T.panel(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return FO.time_folds(counts, 8, 60, 1).select("series_id", "fold", "status")


_RUIN_SQL = ctes.PANEL + """,
num AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS rn FROM panel),
strat AS (SELECT series_id, t, 1.0::DOUBLE AS position,
            CASE WHEN rn IN (5, 6) THEN 0.0::DOUBLE ELSE risk_free_rate END AS risk_free_rate,
            CASE WHEN rn = 5 AND series_id % 4 = 0 THEN NULL WHEN rn = 5 AND series_id % 4 = 1 THEN -1.0::DOUBLE
                 WHEN rn = 5 THEN -1.5::DOUBLE WHEN rn = 6 AND series_id % 4 = 3 THEN -1.25::DOUBLE
                 ELSE forward_returns END AS forward_returns
          FROM num),
sr AS (SELECT *, risk_free_rate * (1 - position) + position * forward_returns AS sr FROM strat),
agg AS (SELECT series_id, count(*) AS n, product(1 + (sr - risk_free_rate)) AS prod, stddev_samp(sr) AS ss FROM sr
        GROUP BY series_id),
x AS (SELECT *, CASE WHEN prod >= 0 THEN power(prod, 1.0 / n) - 1 END AS se FROM agg)"""


def _ruined(spark, sf_dir):
    p = scan.row_index(T.panel(spark, sf_dir), "series_id", "t", out="rn")
    m, at = F.col("series_id") % 4, F.col("rn") + 1
    fr = (F.when((at == 5) & (m == 0), F.lit(None).cast("double")).when((at == 5) & (m == 1), F.lit(-1.0))
          .when(at == 5, F.lit(-1.5)).when((at == 6) & (m == 3), F.lit(-1.25)).otherwise(F.col("forward_returns")))
    return p.select("series_id", "t", F.lit(1.0).alias("position"), fr.alias("forward_returns"),
                    F.when(at.isin(5, 6), F.lit(0.0)).otherwise(F.col("risk_free_rate")).alias("risk_free_rate"))


@register("s5_ruined_strategies", _RUIN_SQL + """
SELECT series_id, n, CASE WHEN prod < 0 THEN NULL ELSE se / ss * sqrt(252) END AS adjusted_sharpe,
       se / ss * sqrt(252) AS sharpe, ss * sqrt(252) * 100 AS strategy_vol, ss * sqrt(252) * 100 AS market_vol,
       1.0 AS vol_penalty, CASE WHEN prod >= 0 THEN 1.0 END AS return_penalty,
       CASE WHEN prod < 0 THEN 'strategy_product_negative' ELSE 'ok' END AS status
FROM x""", SHARPE_OUT)
def s5_ruined_strategies(spark, sf_dir):
    """Full-market positions with a NULL return, a loss of all, of more than all, and two of those."""
    return S.adjusted_sharpe(_ruined(spark, sf_dir), by="series_id")


@register("s8_ruined_curves", _RUIN_SQL + """
SELECT series_id, t, product(1 + forward_returns) OVER (PARTITION BY series_id ORDER BY t
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_strategy FROM strat""", KEY + [("cum_strategy", 6)])
def s8_ruined_curves(spark, sf_dir):
    """Growth curves through returns of -1 and below."""
    return S.cumulative_curves(_ruined(spark, sf_dir), by="series_id", ret="forward_returns")


@register("f13_corr_offset", ctes.PANEL + """,
n AS (SELECT series_id, qty + 1e8::DOUBLE AS a, row_number() OVER (PARTITION BY series_id ORDER BY t) + 1e8::DOUBLE AS b,
             tax AS c FROM panel)
SELECT series_id, corr(a - 1e8::DOUBLE, b - 1e8::DOUBLE) AS ab, corr(a - 1e8::DOUBLE, c) AS ac,
       regr_slope(a - 1e8::DOUBLE, b - 1e8::DOUBLE) AS slope FROM n GROUP BY series_id""",
          [("series_id", "i"), ("ab", 6), ("ac", 6), ("slope", 6)])
def f13_corr_offset(spark, sf_dir):
    """Correlations and an OLS slope of columns with an offset of 1e8."""
    p = scan.row_index(T.panel(spark, sf_dir), "series_id", "t", out="rn")
    p = p.select("series_id", (F.col("qty") + F.lit(1e8)).alias("a"), (F.col("rn") + 1 + F.lit(1e8)).alias("b"),
                 F.col("tax").alias("c"))
    m = PR.corr_matrix(p, ["a", "b", "c"], "series_id")
    pick = lambda y: F.max(F.when((F.col("feature_a") == "a") & (F.col("feature_b") == y), F.col("corr")))
    c = m.groupBy("series_id").agg(pick("b").alias("ab"), pick("c").alias("ac"))
    w = LI.fit(p, ["b"], "a", by="series_id").select("series_id", F.element_at("coef", 1).alias("slope"))
    return c.join(w, "series_id")


@register("c1_sort_by_key", ctes.MARKET + """
SELECT t, row_number() OVER (ORDER BY t) - 1 AS position, px FROM market""",
          [("t", "date"), ("position", "i"), ("px", 6)])
def c1_sort_by_key(spark, sf_dir):
    """Rows in key order: a range-partitioned sort and each row's position."""
    m = scan.row_index(T.market(spark, sf_dir).select("series_id", "t", "px"), "series_id", "t", out="position")
    return m.select("t", "position", "px").sort("t")


@register("c5_sortedness_gaps", """
SELECT bool_and(coalesce(ts >= prev, true)) AS is_sorted, count(*) FILTER (WHERE ts < prev) AS violations
FROM (SELECT ts, lag(ts) OVER (ORDER BY id) AS prev
      FROM (SELECT CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id + 10000000 END AS id, ts FROM events) y) x""",
          [("is_sorted", "b"), ("violations", "i")])
def c5_sortedness_gaps(spark, sf_dir):
    """The order check where the positions have a wide gap."""
    e = T.table(spark, sf_dir, "events")
    pos = F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(F.col("event_id") + 10_000_000)
    return OR.sortedness(e.select(pos.alias("id"), "ts"), "id", "ts")


@register("m3_random_split", ctes.PANEL + """,
h AS (SELECT series_id, t, row_number() OVER (ORDER BY md5(series_id || '-' || t || '-42'), series_id, t) AS r,
             count(*) OVER () AS n FROM panel)
SELECT series_id, t, r <= floor(0.7::DOUBLE * n) AS is_train FROM h""", KEY + [("is_train", "b")])
def m3_random_split(spark, sf_dir):
    """Seeded split with exactly 70 % train rows."""
    return OR.random_split(T.panel(spark, sf_dir).select("series_id", "t"), ["series_id", "t"], 0.7, 42)


@register("u10_grids", ctes.PANEL + """,
r AS (SELECT series_id, CAST(min(qty) AS DOUBLE) AS lo, CAST(max(qty) AS DOUBLE) AS hi FROM panel GROUP BY series_id)
SELECT series_id, i, lo + (hi - lo) * i / 10 AS x, power(10.0::DOUBLE, -4.0 + i * (6.0 / 10)) AS alpha
FROM r, range(0, 11) q(i)""", [("series_id", "i"), ("i", "i"), ("x", 6), ("alpha", 6)])
def u10_grids(spark, sf_dir):
    """An even grid between each series' extremes beside a logarithmic one."""
    r = T.panel(spark, sf_dir).groupBy("series_id").agg(F.min("qty").cast("double").alias("lo"),
                                                        F.max("qty").cast("double").alias("hi"))
    g = r.select("series_id", F.posexplode(F.arrays_zip(CAL.linspace("lo", "hi", 11).alias("x"),
                                                        CAL.logspace(-4.0, 2.0, 11).alias("alpha"))).alias("i", "g"))
    return g.select("series_id", "i", "g.x", "g.alpha")


@register("a5_run_result_json", ctes.PANEL + """
SELECT count(*) FILTER (WHERE m > 2) = 0 AS Succeeded, CASE WHEN count(*) FILTER (WHERE m > 2) = 0 THEN 0 ELSE 1 END AS ErrorType,
       CASE WHEN count(*) FILTER (WHERE m > 2) > 0 THEN 'InvalidSubmission' END AS ErrorName,
       CASE WHEN count(*) FILTER (WHERE m > 2) > 0 THEN 'position_above_max' ELSE '' END AS ErrorDetails
FROM (SELECT series_id, max(CASE WHEN series_id % 4 = 1 THEN 2.0 + 100 * forward_returns ELSE 1.0 END) AS m
      FROM panel GROUP BY series_id) x""",
          [("Succeeded", "b"), ("ErrorType", "i"), ("ErrorName", "s"), ("ErrorDetails", "s")])
def a5_run_result_json(spark, sf_dir):
    """The run result written as JSON and read back."""
    p = T.panel(spark, sf_dir)
    pos = F.when(F.col("series_id") % 4 == 1, 2.0 + 100 * F.col("forward_returns")).otherwise(1.0)
    st = S.adjusted_sharpe(p.withColumn("position", pos), by="series_id").select("series_id", "status")
    path = ST.scratch(spark, "a5")
    IO.write_run_result(st, path)
    return spark.read.schema("Succeeded boolean, ErrorType int, ErrorName string, ErrorDetails string").json(path)


@register("t3_batch_validation", ctes.PANEL + """,
e AS (SELECT series_id % 6 AS batch_id, series_id, t, day(t) = 7 AS odd, qty FROM panel),
p AS (SELECT batch_id, series_id, t, CASE WHEN odd AND batch_id = 4 THEN 'infinity'::DOUBLE WHEN odd AND batch_id = 5 THEN NULL
             ELSE CAST(qty AS DOUBLE) END AS v FROM e WHERE NOT (odd AND batch_id = 1)
      UNION ALL SELECT batch_id, series_id + CASE WHEN batch_id = 2 THEN 100000 ELSE 0 END, t, 1.0 FROM e
      WHERE odd AND batch_id IN (2, 3)),
g AS (SELECT batch_id, series_id, t, count(*) AS r, count(*) FILTER (WHERE v IS NULL OR isinf(v)) AS b FROM p GROUP BY ALL),
j AS (SELECT coalesce(g.batch_id, e.batch_id) AS batch_id, coalesce(r, 0) AS r, coalesce(b, 0) AS b,
             CASE WHEN e.t IS NULL THEN 0 ELSE 1 END AS e
      FROM g FULL JOIN e ON g.batch_id = e.batch_id AND g.series_id = e.series_id AND g.t = e.t),
a AS (SELECT batch_id, sum(r) AS received, sum(e) AS expected, count(*) FILTER (WHERE e > 0 AND r = 0) AS missing,
             count(*) FILTER (WHERE e = 0) AS unexpected, sum(greatest(r - 1, 0)) AS repeated, sum(b) AS bad_values
      FROM j GROUP BY batch_id)
SELECT *, CASE WHEN bad_values > 0 THEN 'invalid_prediction' WHEN repeated > 0 THEN 'repeated_id'
               WHEN missing > 0 OR unexpected > 0 THEN 'id_mismatch' ELSE 'ok' END AS status FROM a""",
          [("batch_id", "i"), ("received", "i"), ("expected", "i"), ("missing", "i"), ("unexpected", "i"),
           ("repeated", "i"), ("bad_values", "i"), ("status", "s")])
def t3_batch_validation(spark, sf_dir):
    """Batches with missing, unexpected, repeated, infinite and NULL predictions, and one that is right."""
    e = T.panel(spark, sf_dir).select((F.col("series_id") % 6).alias("batch_id"), "series_id", "t",
                                      F.col("qty").cast("double").alias("prediction"))
    odd, b = F.dayofmonth("t") == 7, F.col("batch_id")
    v = F.when(odd & (b == 4), F.lit(float("inf"))).when(odd & (b == 5), F.lit(None).cast("double")) \
        .otherwise(F.col("prediction"))
    more = e.where(odd & b.isin(2, 3)).withColumn("series_id", F.col("series_id") + F.when(b == 2, 100_000).otherwise(0))
    pred = e.where(~(odd & (b == 1))).withColumn("prediction", v).unionByName(more)
    return ST.validate_batches(pred, e, ["series_id", "t"])


# ---------------------------------------------------- operators on a NULL key

_KEYED = "CASE WHEN l_suppkey = 3 THEN -1 ELSE l_suppkey END AS series_id"


def _twin(name: str) -> tuple[str, list]:
    """The twin of a registered query over the panel whose series 3 has no key."""
    q = REGISTRY[name]
    sql = q.sql.replace("l_suppkey AS series_id", _KEYED).replace("GROUP BY l_suppkey, CAST(l_shipdate AS DATE))", "GROUP BY ALL)")
    return f"SELECT * REPLACE (CASE WHEN series_id >= 0 THEN series_id END AS series_id) FROM ({sql}) AS keyed", list(q.out)


def _numbered_key():
    return F.when(F.col("l_suppkey") == 3, F.lit(-1)).otherwise(F.col("l_suppkey")).cast("long")


def _no_key(df):
    return df.withColumn("series_id", F.when(F.col("series_id") >= 0, F.col("series_id")))


@register("p8_first_complete_null_key", *_twin("p8_first_complete"))
def p8_first_complete_null_key(spark, sf_dir):
    """P8 where one series has no key."""
    g = _no_key(T.panel_gaps(spark, sf_dir, _numbered_key()))
    return FE.first_complete(g, ["P1", "E1", "V1"]).select("series_id", "t", "P1", "E1", "V1")


@register("p9_median_fill_null_key", *_twin("p9_median_fill"))
def p9_median_fill_null_key(spark, sf_dir):
    """P9 by medians where one series has no key."""
    g = _no_key(T.panel_gaps(spark, sf_dir, _numbered_key()))
    return FE.impute_global_median(g, ["E1", "P1"]).select("series_id", "t", "E1", "P1")


@register("p6_example_dataset_null_key", *_twin("p6_example_dataset"))
def p6_example_dataset_null_key(spark, sf_dir):
    """P6 where one series has no key."""
    return FE.example_dataset(_no_key(_example_src(spark, sf_dir, _numbered_key())))


@register("w16_bfill_ffill_null_key", *_twin("w16_bfill_ffill"))
def w16_bfill_ffill_null_key(spark, sf_dir):
    """Carried values where one series has no key."""
    g, names = _no_key(T.panel_gaps(spark, sf_dir, _numbered_key())), ("P1", "E1", "M1")
    f = scan.carry(g, {f"{k}_{c}": (k, c) for c in names for k in ("next", "last")}, span=200)
    return f.select("series_id", "t", *[F.coalesce(f"next_{c}", f"last_{c}").alias(f"{c.lower()}_filled") for c in names])


@register("w3_rolling_std_null_key", *_twin("w3_rolling_std"))
def w3_rolling_std_null_key(spark, sf_dir):
    """Rolling std over blocks of 300 rows where one series has no key."""
    p = _no_key(T.panel(spark, sf_dir, _numbered_key()).select("series_id", "t", "forward_returns"))
    return scan.series_pass(p, {f"fr_std_{k}": scan.Stat("std", "forward_returns", k) for k in FE.WINDOWS},
                            block_rows=300).drop("forward_returns")


@register("s7_perf_metrics_null_key", *_twin("s7_perf_metrics"))
def s7_perf_metrics_null_key(spark, sf_dir):
    """Performance metrics where one strategy has no key."""
    return S.perf_metrics(_no_key(T.scores(spark, sf_dir, _numbered_key())).withColumnRenamed("prediction", "position"), by="series_id")


@register("f1_describe_null_key", ctes.PANEL + """,
k AS (SELECT CASE WHEN series_id <> 3 THEN series_id END AS series_id, px FROM panel)
SELECT series_id, count(px) AS count, avg(px) AS mean, stddev_samp(px) AS std, min(px) AS min, quantile_cont(px, 0.25) AS q25,
       quantile_cont(px, 0.5) AS q50, quantile_cont(px, 0.75) AS q75, max(px) AS max FROM k GROUP BY series_id""",
          [("series_id", "i"), ("count", "i"), *((c, 6) for c in ("mean", "std", "min", "q25", "q50", "q75", "max"))])
def f1_describe_null_key(spark, sf_dir):
    """Describe by series where one has no key."""
    p = T.panel(spark, sf_dir).select(F.when(F.col("series_id") != 3, F.col("series_id")).alias("series_id"), "px")
    return PR.describe(p, by="series_id", value="px")


@register("f10_box_null_key", ctes.PANEL + """,
k AS (SELECT CASE WHEN series_id <> 3 THEN series_id END AS series_id, px FROM panel),
q AS (SELECT series_id, quantile_cont(px, 0.25) AS q1, quantile_cont(px, 0.5) AS median, quantile_cont(px, 0.75) AS q3
      FROM k GROUP BY series_id)
SELECT q.series_id, q1, median, q3, count(*) FILTER (WHERE NOT (px BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
FROM k JOIN q ON k.series_id IS NOT DISTINCT FROM q.series_id GROUP BY ALL""",
          [("series_id", "i"), ("q1", 6), ("median", 6), ("q3", 6), ("outliers", "i")])
def f10_box_null_key(spark, sf_dir):
    """Box statistics by series where one has no key."""
    p = T.panel(spark, sf_dir).select(F.when(F.col("series_id") != 3, F.col("series_id")).alias("series_id"), "px")
    return PR.box_stats(p, "px", by="series_id")


@register("s2_s3_null_key", ctes.PANEL + """,
k AS (SELECT CASE WHEN series_id <> 3 THEN series_id END AS series_id, t, forward_returns AS p, qty AS v FROM panel),
st AS (SELECT series_id, avg(p) AS mu, stddev_pop(p) AS sigma, median(v) AS vm FROM k GROUP BY series_id)
SELECT k.series_id, k.t, v / vm AS vol_factor,
       least(greatest(1 + 0.25 / (1 + 0.5 * (v / vm)) * (p - mu) / sigma, 0), 2) AS position
FROM k JOIN st ON k.series_id IS NOT DISTINCT FROM st.series_id""", KEY + [("vol_factor", 6), ("position", 6)])
def s2_s3_null_key(spark, sf_dir):
    """Vol factor and positions where one series has no key."""
    p = T.panel(spark, sf_dir).select(F.when(F.col("series_id") != 3, F.col("series_id")).alias("series_id"), "t",
                                      F.col("forward_returns").alias("y_pred"), F.col("qty").cast("double").alias("v"))
    d = S.vol_factor(p, "v", by="series_id").withColumn("rmse_factor", F.lit(0.0))
    return S.signal_to_position(d, S.pred_stats(p, "series_id"), "series_id", regime=None)
