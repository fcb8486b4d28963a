"""Registered queries: profiling and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.catalog import ctes
from panelkit.catalog.spec import register
from panelkit.operators import features as FE
from panelkit.operators import profile as PR
from panelkit.operators import score as S
from panelkit.sources import tables as T

FEATS = ["px", "qty", "disc", "tax"]
GAPS = ["P1", "E1", "V1", "M1", "D1"]

_LONG = """,
wide AS (SELECT series_id, t, px, qty, disc, tax, forward_returns FROM panel),
lng AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR feature IN (px, qty, disc, tax)))"""
_GLONG = """,
gw AS (SELECT series_id, t, P1, E1, V1, M1, D1 FROM panel_gaps),
lng AS (SELECT * FROM gw UNPIVOT INCLUDE NULLS (value FOR feature IN (P1, E1, V1, M1, D1)))"""


def _long(spark, sf_dir):
    p = T.panel(spark, sf_dir)
    return FE.to_long(p.select("series_id", "t", "forward_returns", *FEATS), FEATS,
                      keys=("series_id", "t", "forward_returns"))


def _glong(spark, sf_dir):
    return FE.to_long(T.panel_gaps(spark, sf_dir), GAPS)


@register("f1_describe", ctes.PANEL + _LONG + """
SELECT feature, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
       quantile_cont(value, 0.75) AS q75, max(value) AS max
FROM lng GROUP BY feature""",
          [("feature", "s"), ("count", "i"), ("mean", 6), ("std", 6), ("min", 6), ("q25", 6),
           ("q50", 6), ("q75", 6), ("max", 6)])
def f1_describe(spark, sf_dir):
    """describe() per feature over all series; exact distributed quartiles."""
    return PR.describe(_long(spark, sf_dir), by="feature")


@register("f2_null_profile", ctes.PANEL + ctes.GAPS + _GLONG + """
SELECT feature, count(*) FILTER (WHERE value IS NULL) AS null_count, count(*) AS rows,
       100.0 * count(*) FILTER (WHERE value IS NULL) / count(*) AS null_pct
FROM lng GROUP BY feature HAVING count(*) FILTER (WHERE value IS NULL) > 0""",
          [("feature", "s"), ("null_count", "i"), ("rows", "i"), ("null_pct", 6)])
def f2_null_profile(spark, sf_dir):
    return PR.null_profile(_glong(spark, sf_dir))


@register("f3_null_mask", ctes.PANEL + ctes.GAPS + _GLONG + """
SELECT feature, year(t) AS bucket, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS null_share
FROM lng GROUP BY feature, year(t)""",
          [("feature", "s"), ("bucket", "i"), ("null_share", 6)])
def f3_null_mask(spark, sf_dir):
    return PR.null_mask(_glong(spark, sf_dir), F.year("t"))


@register("f4_f7_moments", ctes.PANEL + """,
m AS (SELECT series_id, avg(forward_returns) AS mu FROM panel GROUP BY series_id),
c AS (SELECT p.series_id, p.forward_returns - m.mu AS d FROM panel p JOIN m USING (series_id)),
cm AS (SELECT series_id, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM c
       GROUP BY series_id),
b AS (SELECT series_id, count(forward_returns) AS n, avg(forward_returns) AS mean,
             median(forward_returns) AS median, stddev_samp(forward_returns) AS std
      FROM panel GROUP BY series_id)
SELECT b.series_id, n, mean, median, std, mean / nullif(std, 0) AS snr,
       m3 / power(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2) AS skew,
       (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) AS kurt,
       n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4) AS jarque_bera
FROM b JOIN cm USING (series_id)""",
          [("series_id", "i"), ("n", "i"), ("mean", 6), ("median", 6), ("std", 6), ("snr", 6),
           ("skew", 6), ("kurt", 6), ("jarque_bera", 6)])
def f4_f7_moments(spark, sf_dir):
    """Mean, median, std, SNR, G1 skewness, G2 excess kurtosis, Jarque-Bera per series."""
    return PR.moments(T.panel(spark, sf_dir), "forward_returns", by="series_id")


@register("f8_histogram", ctes.PANEL + """,
wide AS (SELECT series_id, t, px, qty FROM panel),
lng AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR feature IN (px, qty))),
mm AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lng GROUP BY feature),
b AS (SELECT l.feature, mm.lo, mm.hi,
             CAST(CASE WHEN mm.hi = mm.lo THEN 0
                  ELSE least(floor((l.value - mm.lo) / ((mm.hi - mm.lo) / 200)), 199) END AS INTEGER) AS bin
      FROM lng l JOIN mm USING (feature) WHERE l.value IS NOT NULL)
SELECT feature, bin, lo + bin * ((hi - lo) / 200) AS "left", lo + (bin + 1) * ((hi - lo) / 200) AS "right",
       count(*) AS count
FROM b GROUP BY feature, bin, lo, hi""",
          [("feature", "s"), ("bin", "i"), ("left", 6), ("right", 6), ("count", "i")])
def f8_histogram(spark, sf_dir):
    """200 equal-width bins per feature; the maximum falls in the last bin.

    On px / qty: the 2-decimal disc / tax averages sit exactly on bin edges,
    where last-bit differences between engines move them across."""
    p = T.panel(spark, sf_dir)
    return PR.histogram(FE.to_long(p, ["px", "qty"]), "value", 200, by="feature")


@register("f9_kde", None, [("feature", "s"), ("i", "i"), ("g", 6), ("density", 6)])
def f9_kde(spark, sf_dir):
    """Gaussian KDE on a 200-point grid per feature, from 1 024 linear bins (rows only: a unit test holds it
    against the exact sum and the stated bound)."""
    return PR.kde_curve(_long(spark, sf_dir), "value", 200, by="feature")


@register("f10_box_stats", ctes.PANEL + _LONG + """,
q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM lng GROUP BY feature)
SELECT feature, q1, median, q3,
       min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_lo,
       max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_hi,
       count(*) FILTER (WHERE NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
FROM lng JOIN q USING (feature) WHERE value IS NOT NULL GROUP BY feature, q1, median, q3""",
          [("feature", "s"), ("q1", 6), ("median", 6), ("q3", 6), ("whisker_lo", 6), ("whisker_hi", 6),
           ("outliers", "i")])
def f10_box_stats(spark, sf_dir):
    return PR.box_stats(_long(spark, sf_dir), "value", by="feature")


@register("f11_sigma_band", ctes.PANEL + """,
st AS (SELECT series_id, avg(forward_returns) AS mu, stddev_samp(forward_returns) AS sd FROM panel
       GROUP BY series_id)
SELECT p.series_id, p.t, CASE WHEN abs(p.forward_returns - st.mu) > 2 * st.sd THEN 1 ELSE 0 END AS extreme,
       st.mu - 2 * st.sd AS band_lo, st.mu + 2 * st.sd AS band_hi
FROM panel p JOIN st USING (series_id)""",
          [("series_id", "i"), ("t", "date"), ("extreme", "i"), ("band_lo", 6), ("band_hi", 6)])
def f11_sigma_band(spark, sf_dir):
    b = PR.sigma_band(T.panel(spark, sf_dir), "forward_returns", 2.0, by="series_id")
    return b.select("series_id", "t", "extreme", "band_lo", "band_hi")


@register("f12_target_correlation", ctes.PANEL + _LONG + """
SELECT feature, corr(value, forward_returns) AS corr FROM lng GROUP BY feature""",
          [("feature", "s"), ("corr", 6)])
def f12_target_correlation(spark, sf_dir):
    """Correlation of every feature with the target, without the p x p matrix."""
    return PR.target_correlations(_long(spark, sf_dir), "forward_returns")


def _pairs_sql(cols, src, by=None):
    parts = []
    g = f"{by}, " if by else ""
    for a in cols:
        for b in cols:
            parts.append(
                f"SELECT {g}'{a}' AS feature_a, '{b}' AS feature_b, "
                f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
                f"CASE WHEN count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) > 1 "
                f"THEN corr({a}, {b}) END AS corr FROM {src}" + (f" GROUP BY {by}" if by else ""))
    return "\nUNION ALL\n".join(parts)


@register("f13_corr_matrix", ctes.PANEL + ctes.GAPS + """,
cm AS (""" + _pairs_sql(["P1", "E1", "V1", "M1"], "panel_gaps") + """)
SELECT feature_a, feature_b, n, CASE WHEN isnan(corr) OR isinf(corr) THEN NULL ELSE corr END AS corr FROM cm""",
          [("feature_a", "s"), ("feature_b", "s"), ("n", "i"), ("corr", 6)])
def f13_corr_matrix(spark, sf_dir):
    """Pairwise-complete correlation matrix from per-batch Gram partial sums."""
    return PR.corr_matrix(T.panel_gaps(spark, sf_dir), ["P1", "E1", "V1", "M1"])


_PRED = ctes.PANEL + ctes.SCORES + """,
e AS (SELECT series_id, t, year(t) AS fold, forward_returns AS y, 0.01 * (prediction - 1) AS y_pred FROM scores)"""


@register("f14_ic_by_fold", _PRED + """
SELECT fold, CASE WHEN isnan(corr(y, y_pred)) THEN NULL ELSE corr(y, y_pred) END AS ic FROM e GROUP BY fold""",
          [("fold", "i"), ("ic", 6)])
def f14_ic_by_fold(spark, sf_dir):
    """Information coefficient per fold (here: per calendar year)."""
    return S.ic_by(_pred(spark, sf_dir), "fold", y="y", yhat="y_pred")


def _pred(spark, sf_dir):
    s = T.scores(spark, sf_dir)
    return s.select("series_id", "t", F.year("t").alias("fold"), F.col("forward_returns").alias("y"),
                    (0.01 * (F.col("prediction") - 1)).alias("y_pred"))


_REG_SQL = """,
r AS (SELECT series_id, count(*) AS n, sum((y - y_pred) * (y - y_pred)) AS sse,
             avg((y - y_pred) * (y - y_pred)) AS mse, avg(abs(y - y_pred)) AS mae,
             var_pop(y) * count(y) AS sst FROM e GROUP BY series_id),
m AS (SELECT series_id, n, 1 - sse / nullif(sst, 0) AS r2, mse, sqrt(mse) AS rmse, mae FROM r)"""


@register("f15_regression_metrics", _PRED + _REG_SQL + "\nSELECT * FROM m",
          [("series_id", "i"), ("n", "i"), ("r2", 6), ("mse", 6), ("rmse", 6), ("mae", 6)])
def f15_regression_metrics(spark, sf_dir):
    """R^2 = 1 - SSE/SST (not squared correlation), MSE, RMSE, MAE per group."""
    return S.regression_metrics(_pred(spark, sf_dir), "series_id")


@register("f16_metric_summary", _PRED + _REG_SQL + """
SELECT avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std, avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std,
       max(r2) AS r2_max, count(*) AS groups FROM m""",
          [("r2_mean", 6), ("r2_std", 6), ("rmse_mean", 6), ("rmse_std", 6), ("r2_max", 6), ("groups", "i")])
def f16_metric_summary(spark, sf_dir):
    """Mean +- population std and max of per-group metrics."""
    m = S.regression_metrics(_pred(spark, sf_dir), "series_id")
    return m.agg(F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"),
                 F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"),
                 F.max("r2").alias("r2_max"), F.count(F.lit(1)).alias("groups"))


@register("f17_fit_line", _PRED + """,
a AS (SELECT series_id, regr_slope(y, y_pred) AS slope, regr_intercept(y, y_pred) AS intercept,
             min(y_pred) AS lo, max(y_pred) AS hi FROM e GROUP BY series_id),
g AS (SELECT a.*, i FROM a, generate_series(0, 199) AS s(i))
SELECT series_id, slope, intercept, i, lo + (hi - lo) * i / 199 AS x,
       intercept + slope * (lo + (hi - lo) * i / 199) AS y_fit FROM g""",
          [("series_id", "i"), ("slope", 6), ("intercept", 6), ("i", "i"), ("x", 6), ("y_fit", 6)])
def f17_fit_line(spark, sf_dir):
    """Least-squares line of y on the prediction and a 200-point grid per series."""
    return PR.fit_line(_pred(spark, sf_dir), "y_pred", "y", by="series_id")


@register("f18_product", ctes.PANEL + """
SELECT series_id, product(1 + forward_returns) AS growth,
       power(product(1 + forward_returns), 1.0 / count(*)) - 1 AS geo_mean FROM panel GROUP BY series_id""",
          [("series_id", "i"), ("growth", 6), ("geo_mean", 6)])
def f18_product(spark, sf_dir):
    """Product aggregate and geometric mean (log-sum form, overflow-free)."""
    p = T.panel(spark, sf_dir)
    return p.groupBy("series_id").agg(F.product(1 + F.col("forward_returns")).alias("growth"),
                                      S.geo_mean("forward_returns").alias("geo_mean"))


@register("f19_unique_count", ctes.PANEL + ctes.GAPS + """,
gw AS (SELECT series_id, t, E1, D1, CAST(rn AS DOUBLE) AS R1 FROM panel_gaps),
lng AS (SELECT * FROM gw UNPIVOT INCLUDE NULLS (value FOR feature IN (E1, D1, R1)))
SELECT feature, count(DISTINCT coalesce(value, -9999.0)) AS n_unique FROM lng GROUP BY feature""",
          [("feature", "s"), ("n_unique", "i")])
def f19_unique_count(spark, sf_dir):
    """Distinct values per feature after the sentinel fill (constant detection).

    Run on exactly representable columns (integer sums, a constant, row
    positions): averaged doubles can differ in the last bit between engines."""
    g = T.panel_gaps(spark, sf_dir).withColumn("R1", F.col("rn").cast("double"))
    lng = FE.to_long(g, ["E1", "D1", "R1"])
    return lng.groupBy("feature").agg(F.count_distinct(F.coalesce("value", F.lit(FE.SENTINEL))).alias("n_unique"))


@register("f21_remaining_nulls", ctes.PANEL + ctes.GAPS + """
SELECT sum(CASE WHEN coalesce(P1, -9999.0) IS NULL THEN 1 ELSE 0 END
         + CASE WHEN coalesce(E1, -9999.0) IS NULL THEN 1 ELSE 0 END
         + CASE WHEN coalesce(M1, -9999.0) IS NULL THEN 1 ELSE 0 END) AS remaining_nulls,
       sum(CASE WHEN P1 IS NULL THEN 1 ELSE 0 END + CASE WHEN E1 IS NULL THEN 1 ELSE 0 END
         + CASE WHEN M1 IS NULL THEN 1 ELSE 0 END) AS filled
FROM panel_gaps""", [("remaining_nulls", "i"), ("filled", "i")])
def f21_remaining_nulls(spark, sf_dir):
    """Null check after the P3 fill: 0 remaining, and how many were filled."""
    g = T.panel_gaps(spark, sf_dir).select("series_id", "t", "P1", "E1", "M1")
    before = g.select(sum(F.col(c).isNull().cast("long") for c in ("P1", "E1", "M1")).alias("x"))
    out, _ = FE.impute(g)
    after = out.select(sum(F.col(c).isNull().cast("long") for c in ("P1", "E1", "M1")).alias("x"))
    a = after.agg(F.sum("x").alias("remaining_nulls")).withColumn("pk_one", F.lit(1))
    b = before.agg(F.sum("x").alias("filled")).withColumn("pk_one", F.lit(1))
    return a.join(b, "pk_one").drop("pk_one")


_GRAM_COLS = ["E1", "D1", "R1"]


@register("m1_gram", ctes.PANEL + ctes.GAPS + """,
x AS (SELECT series_id, E1, D1, CAST(rn AS DOUBLE) AS R1 FROM panel_gaps),
pairs AS (""" + "\nUNION ALL\n".join(
    f"SELECT series_id, {i} AS i, {j} AS j, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
    f"sum({a}) FILTER (WHERE {b} IS NOT NULL) AS sx, sum({b}) FILTER (WHERE {a} IS NOT NULL) AS sy, "
    f"sum({a} * {a}) FILTER (WHERE {b} IS NOT NULL) AS sxx, sum({b} * {b}) FILTER (WHERE {a} IS NOT NULL) AS syy, "
    f"sum({a} * {b}) AS sxy FROM x GROUP BY series_id"
    for i, a in enumerate(_GRAM_COLS) for j, b in enumerate(_GRAM_COLS)) + """)
SELECT series_id, i, j, n, coalesce(sx, 0) AS sx, coalesce(sy, 0) AS sy, coalesce(sxx, 0) AS sxx,
       coalesce(syy, 0) AS syy, coalesce(sxy, 0) AS sxy FROM pairs""",
          [("series_id", "i"), ("i", "i"), ("j", "i"), ("n", 6), ("sx", 6), ("sy", 6), ("sxx", 6),
           ("syy", 6), ("sxy", 6)])
def m1_gram(spark, sf_dir):
    """Pairwise-complete sufficient statistics per series from batch partial sums.

    Checked on exactly representable columns (integer quantities with gaps, a
    constant, row positions) so sums agree bit for bit across engines."""
    g = T.panel_gaps(spark, sf_dir).withColumn("R1", F.col("rn").cast("double"))
    return PR.gram(g, _GRAM_COLS, by="series_id")
