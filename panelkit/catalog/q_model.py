"""Registered queries: folds, linear models, walk-forward."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.catalog import ctes
from panelkit.catalog import sqlgen as G
from panelkit.catalog.spec import register
from panelkit.operators import features as FE
from panelkit.operators import folds as FO
from panelkit.operators import linear as LI
from panelkit.operators import rolling as R
from panelkit.plans import scan
from panelkit.plans import walkforward as WF
from panelkit.sources import tables as T

K, SIZE, GAP = 8, 252, 1

_FOLDS_SQL = ctes.MARKET + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS rn FROM market),
cnt AS (SELECT series_id, count(*) AS n FROM market GROUP BY series_id),
f0 AS (SELECT series_id, n, i + 1 AS fold, n - ({K} - i) * {SIZE} AS test_lo FROM cnt, range(0, {K}) r(i)),
folds AS (SELECT *, test_lo + {SIZE} AS test_hi, test_lo - {GAP} AS train_hi,
                 test_lo - {GAP} - greatest(least(floor((test_lo - {GAP}) / 5), 252), 50) AS fit_hi
          FROM f0 WHERE n > {K} * {SIZE}),
assigned AS (SELECT r.*, f.fold, f.test_lo, f.test_hi, f.train_hi, f.fit_hi,
                    CASE WHEN r.rn >= f.test_lo AND r.rn < f.test_hi THEN 'test'
                         WHEN r.rn < f.fit_hi THEN 'fit'
                         WHEN r.rn < f.train_hi THEN 'eval' END AS role
             FROM numbered r JOIN folds f ON r.series_id = f.series_id
             WHERE r.rn < f.test_hi)"""


def _market_folds(spark, sf_dir):
    m = T.market(spark, sf_dir)
    base = scan.row_index(m, "series_id", "t", out="rn")
    counts = base.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    folds = FO.time_folds(counts, K, SIZE, GAP)
    return base, folds


@register("v1_time_folds", _FOLDS_SQL + "\nSELECT series_id, fold, n, test_lo, test_hi, train_hi, fit_hi FROM folds",
          [("series_id", "i"), ("fold", "i"), ("n", "i"), ("test_lo", "i"), ("test_hi", "i"),
           ("train_hi", "i"), ("fit_hi", "i")])
def v1_time_folds(spark, sf_dir):
    """8 x 252 expanding folds with a 1-row purge gap and the early-stop eval tail (V1-V3)."""
    _, folds = _market_folds(spark, sf_dir)
    return folds.where("valid").select("series_id", "fold", "n", "test_lo", "test_hi", "train_hi", "fit_hi")


@register("e6_fold_range_join", _FOLDS_SQL + """
SELECT fold, role, count(*) AS rows, min(t) AS first_t, max(t) AS last_t FROM assigned
WHERE role IS NOT NULL GROUP BY fold, role""",
          [("fold", "i"), ("role", "s"), ("rows", "i"), ("first_t", "date"), ("last_t", "date")])
def e6_fold_range_join(spark, sf_dir):
    """Rows matched to fold intervals by key equality + range filter."""
    base, folds = _market_folds(spark, sf_dir)
    a = FO.assign_roles(base, folds)
    return a.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("t").alias("first_t"),
                                         F.max("t").alias("last_t"))


@register("v5_fold_metadata", _FOLDS_SQL + """
SELECT series_id, fold,
       min(CASE WHEN role <> 'test' THEN t END) AS train_start, max(CASE WHEN role <> 'test' THEN t END) AS train_end,
       min(CASE WHEN role = 'test' THEN t END) AS test_start, max(CASE WHEN role = 'test' THEN t END) AS test_end,
       count(*) FILTER (WHERE role <> 'test') AS train_size, count(*) FILTER (WHERE role = 'test') AS test_size
FROM assigned WHERE role IS NOT NULL GROUP BY series_id, fold""",
          [("series_id", "i"), ("fold", "i"), ("train_start", "date"), ("train_end", "date"),
           ("test_start", "date"), ("test_end", "date"), ("train_size", "i"), ("test_size", "i")])
def v5_fold_metadata(spark, sf_dir):
    base, folds = _market_folds(spark, sf_dir)
    return FO.fold_metadata(FO.assign_roles(base, folds), "t", "series_id")


@register("v6_kfold_contiguous", ctes.PANEL + """,
n AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS rn,
             count(*) OVER (PARTITION BY series_id) AS n FROM panel),
k AS (SELECT *, n // 10 AS q, n % 10 AS r FROM n)
SELECT series_id, t, CAST(CASE WHEN rn < r * (q + 1) THEN rn // (q + 1)
                               ELSE r + (rn - r * (q + 1)) // q END AS INTEGER) AS fold
FROM k""", [("series_id", "i"), ("t", "date"), ("fold", "i")])
def v6_kfold_contiguous(spark, sf_dir):
    """KFold(10) without shuffling per series: the first n % 10 folds are one row larger."""
    p = scan.row_index(T.panel(spark, sf_dir), "series_id", "t", out="rn")
    c = p.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return FO.kfold_contiguous(p.join(c, "series_id"), 10).select("series_id", "t", "fold")


@register("e7_fold_out_complement", ctes.PANEL + """,
n AS (SELECT series_id, t, forward_returns, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS rn,
             count(*) OVER (PARTITION BY series_id) AS n FROM panel),
k AS (SELECT *, CASE WHEN rn < (n % 10) * (n // 10 + 1) THEN rn // (n // 10 + 1)
                     ELSE n % 10 + (rn - (n % 10) * (n // 10 + 1)) // (n // 10) END AS fold FROM n),
f AS (SELECT series_id, fold, count(*) AS n_in, sum(forward_returns) AS s_in FROM k GROUP BY series_id, fold),
tot AS (SELECT series_id, sum(n_in) AS n_all, sum(s_in) AS s_all FROM f GROUP BY series_id)
SELECT f.series_id, CAST(f.fold AS INTEGER) AS fold, n_all - n_in AS n_out, s_all - s_in AS s_out
FROM f JOIN tot USING (series_id)""",
          [("series_id", "i"), ("fold", "i"), ("n_out", "i"), ("s_out", 6)])
def e7_fold_out_complement(spark, sf_dir):
    """Left-out statistics as total minus fold (no anti join, no second scan)."""
    p = scan.row_index(T.panel(spark, sf_dir), "series_id", "t", out="rn")
    c = p.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    k = FO.kfold_contiguous(p.join(c, "series_id"), 10)
    f = k.groupBy("series_id", "fold").agg(F.count(F.lit(1)).alias("n_in"), F.sum("forward_returns").alias("s_in"))
    tot = f.groupBy("series_id").agg(F.sum("n_in").alias("n_all"), F.sum("s_in").alias("s_all"))
    return f.join(tot, "series_id").select("series_id", "fold", (F.col("n_all") - F.col("n_in")).alias("n_out"),
                                           (F.col("s_all") - F.col("s_in")).alias("s_out"))


@register("w21_residual_rmse", _FOLDS_SQL + f""",
res AS (SELECT a.*, a.forward_returns - avg(a.forward_returns) OVER (PARTITION BY a.fold ORDER BY a.rn
                 ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS resid
        FROM (SELECT s.*, m.forward_returns FROM assigned s JOIN market m USING (series_id, t)) a
        WHERE role IN ('fit', 'eval')),
rr AS (SELECT fold, rn, {G.roll('avg', 'resid * resid', 126, 50, 'fold', 'rn')} AS mt,
              {G.roll('avg', 'resid * resid', 252, 50, 'fold', 'rn')} AS mb FROM res),
a AS (SELECT fold, sqrt(arg_max(mt, rn)) AS rmse_tail, median(sqrt(mb)) AS b FROM rr GROUP BY fold)
SELECT fold, rmse_tail, CASE WHEN b IS NULL OR b = 0 THEN greatest(rmse_tail, 1e-6) ELSE b END AS rmse_base,
       rmse_tail / CASE WHEN b IS NULL OR b = 0 THEN greatest(rmse_tail, 1e-6) ELSE b END AS rmse_factor
FROM a""", [("fold", "i"), ("rmse_tail", 6), ("rmse_base", 6), ("rmse_factor", 6)])
def w21_residual_rmse(spark, sf_dir):
    """Residual RMSE at the fold boundary vs the median rolling RMSE of the train rows."""
    base, folds = _market_folds(spark, sf_dir)
    a = FO.assign_roles(base, folds).where(F.col("role").isin("fit", "eval"))
    w = R.series_window(["fold"], "rn")
    a = a.withColumn("resid", F.col("forward_returns") - F.avg("forward_returns").over(w.rowsBetween(-5, -1)))
    return WF.residual_rmse_factor(a, ["fold"]).select("fold", "rmse_tail", "rmse_base", "rmse_factor")


@register("m2_standard_scaler", ctes.PANEL + """,
st AS (SELECT series_id, avg(px) AS mp, stddev_pop(px) AS sp, avg(disc) AS md, stddev_pop(disc) AS sd
       FROM panel GROUP BY series_id)
SELECT p.series_id, p.t, (p.px - st.mp) / CASE WHEN st.sp = 0 OR st.sp IS NULL THEN 1 ELSE st.sp END AS px,
       (p.disc - st.md) / CASE WHEN st.sd = 0 OR st.sd IS NULL THEN 1 ELSE st.sd END AS disc
FROM panel p JOIN st USING (series_id)""", [("series_id", "i"), ("t", "date"), ("px", 6), ("disc", 6)])
def m2_standard_scaler(spark, sf_dir):
    """Standard scaler with population std fitted per series; zero std -> scale 1."""
    p = T.panel(spark, sf_dir)
    st = LI.scaler_fit(p, ["px", "disc"], by="series_id")
    return LI.scaler_apply(p, st, ["px", "disc"], by="series_id").select("series_id", "t", "px", "disc")


@register("m7_ols_one_feature", ctes.PANEL + """
SELECT series_id, regr_intercept(forward_returns, tax) AS intercept, regr_slope(forward_returns, tax) AS slope
FROM panel GROUP BY series_id""", [("series_id", "i"), ("intercept", 6), ("slope", 6)])
def m7_ols_one_feature(spark, sf_dir):
    """OLS from the Gram statistics per series (matches regr_intercept / regr_slope)."""
    m = LI.fit(T.panel(spark, sf_dir), ["tax"], "forward_returns", by="series_id", alpha=0.0)
    return m.select("series_id", "intercept", F.element_at("coef", 1).alias("slope"))


@register("m10_linear_predict", ctes.PANEL + """,
m AS (SELECT series_id, regr_intercept(forward_returns, tax) AS b, regr_slope(forward_returns, tax) AS w
      FROM panel GROUP BY series_id)
SELECT p.series_id, p.t, m.b + p.tax * m.w AS y_pred FROM panel p JOIN m USING (series_id)""",
          [("series_id", "i"), ("t", "date"), ("y_pred", 6)])
def m10_linear_predict(spark, sf_dir):
    p = T.panel(spark, sf_dir)
    m = LI.fit(p, ["tax"], "forward_returns", by="series_id", alpha=0.0)
    return LI.predict(p, m, ["tax"], by="series_id").select("series_id", "t", "y_pred")


@register("m4_lasso", None, [("series_id", "i"), ("intercept", 8), ("w_disc", 8), ("w_tax", 8), ("n", "i")])
def m4_lasso(spark, sf_dir):
    """Lasso alpha = 1 per series on standardised features (all weights shrink to 0)."""
    p = T.panel(spark, sf_dir)
    st = LI.scaler_fit(p, ["disc", "tax"], by="series_id")
    z = LI.scaler_apply(p, st, ["disc", "tax"], by="series_id")
    m = LI.fit(z, ["disc", "tax"], "forward_returns", by="series_id", alpha=1.0, l1_ratio=1.0)
    return m.select("series_id", "intercept", F.element_at("coef", 1).alias("w_disc"),
                    F.element_at("coef", 2).alias("w_tax"), "n")


def _enet_input(spark, sf_dir):
    m = T.market(spark, sf_dir)
    m = scan.row_index(m, "series_id", "t", out="rn")
    c = m.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    m = FO.kfold_contiguous(m.join(c, "series_id"), LI.CV_FOLDS)
    feats = ["disc", "tax", "qty", "px"]
    st = LI.scaler_fit(m, feats, by="series_id")
    return LI.scaler_apply(m, st, feats, by="series_id"), feats


@register("m5_enet_cv_path", None, [("series_id", "i"), ("alpha", 8), ("mse", 8)])
def m5_enet_cv_path(spark, sf_dir):
    """ElasticNetCV (l1 0.5, 100 alphas, 10 contiguous folds) from one Gram scan."""
    z, feats = _enet_input(spark, sf_dir)
    cv, _ = LI.enet_cv(z, feats, "market_forward_excess_returns", by="series_id")
    return cv


@register("m6_enet_refit", None, [("series_id", "i"), ("alpha", 8), ("intercept", 8), ("coef", "s")])
def m6_enet_refit(spark, sf_dir):
    """Refit at the best alpha on all rows."""
    z, feats = _enet_input(spark, sf_dir)
    _, model = LI.enet_cv(z, feats, "market_forward_excess_returns", by="series_id")
    return model


def _wf(spark, sf_dir):
    m = FE.target_log(T.market(spark, sf_dir), out="y_log")
    w = R.series_window()
    m = m.withColumns({"f_lag1": R.lag("y_log", 1, w), "f_mean5": F.avg("y_log").over(w.rowsBetween(-5, -1)),
                       "f_disc": F.col("disc"), "vol21": R.roll_std(R.lag("y_log", 1, w), 21, w)})
    m = m.withColumn("regime", (F.col("vol21") > F.lit(0.004)).cast("int"))
    m = m.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("f_lag1", "f_mean5", "vol21")})
    return WF.walk_forward(m, ["f_lag1", "f_mean5", "f_disc"], "y_log", K, SIZE, GAP, alpha=0.0,
                           vol="vol21", regime="regime")


@register("v4_walk_forward_oof", None,
          [("series_id", "i"), ("t", "date"), ("fold", "i"), ("y_log", 8), ("y_pred_log", 8), ("position", 8)])
def v4_walk_forward_oof(spark, sf_dir):
    """Walk-forward out-of-fold table: fit, predict, position per fold."""
    oof, _ = _wf(spark, sf_dir)
    return oof


@register("v4_walk_forward_folds", None,
          [("series_id", "i"), ("fold", "i"), ("train_size", "i"), ("test_size", "i"), ("r2", 8), ("rmse", 8),
           ("mae", 8), ("adjusted_sharpe", 8), ("rmse_factor", 8), ("status", "s")])
def v4_walk_forward_folds(spark, sf_dir):
    """Per-fold metrics table of the walk-forward run."""
    _, fm = _wf(spark, sf_dir)
    return fm


# the walk-forward run with one feature, which SQL can express: OLS on the fit rows of every fold
_WF_ONE_SQL = _FOLDS_SQL + f""",
src AS (SELECT series_id, t, {G.log1p('market_forward_excess_returns')} AS y, tax AS f, forward_returns AS fr, risk_free_rate AS rf
        FROM market),
vol AS (SELECT *, coalesce({G.roll('stddev_samp', 'y', 21)}, 0) AS v FROM src),
vm AS (SELECT median(v) AS vm FROM vol),
x AS (SELECT a.fold, a.rn, a.role, v.* FROM assigned a JOIN vol v USING (series_id, t) WHERE role IS NOT NULL),
m AS (SELECT fold, regr_slope(y, f) AS w, regr_intercept(y, f) AS b FROM x WHERE role = 'fit' GROUP BY fold),
p AS (SELECT x.*, m.b + m.w * f AS yp FROM x JOIN m USING (fold)),
st AS (SELECT fold, avg(yp) AS mu, stddev_pop(yp) AS sigma FROM p WHERE role <> 'test' GROUP BY fold),
tr AS (SELECT *, (y - yp) * (y - yp) AS e2 FROM p WHERE role <> 'test'),
rr AS (SELECT fold, rn, {G.roll('avg', 'e2', 126, 50, 'fold', 'rn')} AS mt, {G.roll('avg', 'e2', 252, 50, 'fold', 'rn')} AS mb
       FROM tr),
ra AS (SELECT fold, sqrt(arg_max(mt, rn)) AS tail, median(sqrt(mb)) AS base FROM rr GROUP BY fold),
pos AS (SELECT p.*, tail / base AS rmse_factor,
               least(greatest(1 + 0.25 / (1 + 0.5 * (v / vm) + 0.5 * (tail / base)) * (yp - mu) / sigma, 0), 2) AS position
        FROM p JOIN st USING (fold) JOIN ra USING (fold), vm WHERE role = 'test')"""


def _wf_one(spark, sf_dir, fitter=None):
    m = FE.target_log(T.market(spark, sf_dir), out="y_log").withColumn("f", F.col("tax"))
    m = scan.series_pass(m, {"vol21": scan.Stat("std", "y_log", 21)}).withColumn("vol21", F.coalesce("vol21", F.lit(0.0)))
    return WF.walk_forward(m, ["f"], "y_log", K, SIZE, GAP, vol="vol21", fitter=fitter)


@register("v4_one_feature_oof", _WF_ONE_SQL + """
SELECT series_id, t, fold, y AS y_log, yp AS y_pred_log, exp(yp) - 1 AS y_pred_arith, position FROM pos""",
          [("series_id", "i"), ("t", "date"), ("fold", "i"), ("y_log", 8), ("y_pred_log", 8), ("y_pred_arith", 8), ("position", 8)])
def v4_one_feature_oof(spark, sf_dir):
    """Walk-forward over disjoint segments: out-of-fold predictions and positions of an OLS on one feature."""
    oof, _ = _wf_one(spark, sf_dir)
    return oof


@register("v4_one_feature_folds", _WF_ONE_SQL + f""",
d AS (SELECT fold, min(t) FILTER (WHERE role <> 'test') AS train_start, max(t) FILTER (WHERE role <> 'test') AS train_end,
             min(t) FILTER (WHERE role = 'test') AS test_start, max(t) FILTER (WHERE role = 'test') AS test_end,
             count(*) FILTER (WHERE role <> 'test') AS train_size, count(*) FILTER (WHERE role = 'test') AS test_size
      FROM x GROUP BY fold),
e AS (SELECT fold, 1 - sum((y - yp) * (y - yp)) / (var_pop(y) * count(*)) AS r2, avg((y - yp) * (y - yp)) AS mse,
             avg(abs(y - yp)) AS mae, any_value(rmse_factor) AS rmse_factor FROM pos GROUP BY fold)
SELECT 0 AS series_id, d.*, r2, mse, sqrt(mse) AS rmse, mae, rmse_factor, 'ok' AS status FROM d JOIN e USING (fold)""",
          [("series_id", "i"), ("fold", "i"), ("train_start", "date"), ("train_end", "date"), ("test_start", "date"),
           ("test_end", "date"), ("train_size", "i"), ("test_size", "i"), ("r2", 8), ("mse", 8), ("rmse", 8), ("mae", 8),
           ("rmse_factor", 8), ("status", "s")])
def v4_one_feature_folds(spark, sf_dir):
    """The fold table of the same run."""
    _, folds = _wf_one(spark, sf_dir)
    return folds


@register("v4_walk_forward_trees", None,
          [("series_id", "i"), ("fold", "i"), ("status", "s"), ("train_size", "i"), ("test_size", "i"), ("best_iteration", "i"),
           ("r2", 8), ("mse", 8), ("rmse", 8), ("mae", 8), ("adjusted_sharpe", 8)])
def v4_walk_forward_trees(spark, sf_dir):
    """Walk-forward with boosted trees (up to 5 000 rounds, patience 100 on each fold's eval rows)."""
    m = FE.target_log(T.market(spark, sf_dir), out="y_log")
    feats = {"f_lag1": scan.Stat("lag", "y_log", 1), "f_mean5": scan.Stat("mean", "y_log", 5, 1, shift=1),
             "vol21": scan.Stat("std", "y_log", 21, 2, shift=1), "vol252": scan.Stat("std", "y_log", 252, 2, shift=1)}
    m = scan.series_pass(m, feats)
    m = m.withColumns({"f_disc": F.col("disc"), "f_tax": F.col("tax"),
                       "regime": (F.col("vol21") > FE.HIGHVOL_RATIO * F.col("vol252")).cast("int")})
    _, folds = WF.walk_forward(m, ["f_lag1", "f_mean5", "f_disc", "f_tax", "vol21"], "y_log", K, SIZE, GAP, vol="vol21",
                               regime="regime", fitter=WF.TreeFitter())
    return folds


# the solutions of one standardised feature in closed form: soft threshold over 1 + ridge
@register("m4_lasso_one_feature", ctes.PANEL + """,
s AS (SELECT series_id, avg(tax) AS mt, stddev_pop(tax) AS st FROM panel GROUP BY series_id),
z AS (SELECT p.series_id, (tax - mt) / CASE WHEN st = 0 OR st IS NULL THEN 1 ELSE st END AS z, qty AS y
      FROM panel p JOIN s USING (series_id)),
g AS (SELECT series_id, covar_pop(z, y) AS c, var_pop(z) AS v, avg(y) AS my, avg(z) AS mz FROM z GROUP BY series_id),
w AS (SELECT *, sign(c) * greatest(abs(c) - 0.5, 0) / v AS w FROM g)
SELECT series_id, w, my - mz * w AS intercept FROM w""", [("series_id", "i"), ("w", 6), ("intercept", 6)])
def m4_lasso_one_feature(spark, sf_dir):
    """Lasso with a penalty that leaves weights: quantity on the standardised tax, per series."""
    p = T.panel(spark, sf_dir).withColumn("z", F.col("tax"))
    z = LI.scaler_apply(p, LI.scaler_fit(p, ["z"], by="series_id"), ["z"], by="series_id")
    m = LI.fit(z, ["z"], "qty", by="series_id", alpha=0.5, l1_ratio=1.0)
    return m.select("series_id", F.element_at("coef", 1).alias("w"), "intercept")


_ENET_ONE_SQL = ctes.PANEL + """,
n AS (SELECT series_id, t, qty AS y, tax AS x, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS rn,
             count(*) OVER (PARTITION BY series_id) AS n FROM panel),
k AS (SELECT *, CAST(CASE WHEN rn < (n % 10) * (n // 10 + 1) THEN rn // (n // 10 + 1)
                ELSE n % 10 + (rn - (n % 10) * (n // 10 + 1)) // (n // 10) END AS INTEGER) AS fold FROM n),
a AS (SELECT power(10.0::DOUBLE, -4.0 + i * 6.0 / 99) AS alpha FROM range(0, 100) r(i)),
o AS (SELECT f.series_id, f.fold, covar_pop(k.x, k.y) AS c, var_pop(k.x) AS v, avg(k.x) AS mx, avg(k.y) AS my
      FROM (SELECT DISTINCT series_id, fold FROM k) f JOIN k ON k.series_id = f.series_id AND k.fold <> f.fold GROUP BY ALL),
w AS (SELECT series_id, fold, alpha, mx, my, sign(c) * greatest(abs(c) - 0.5 * alpha, 0) / (v + 0.5 * alpha) AS w FROM o, a),
h AS (SELECT series_id, fold, avg(x) AS hx, avg(y) AS hy, var_pop(x) AS hv, var_pop(y) AS hw, covar_pop(x, y) AS hc
      FROM k GROUP BY ALL),
l AS (SELECT series_id, alpha, avg(hw - 2 * w * hc + w * w * hv + power(hy - my - w * (hx - mx), 2)) AS mse
      FROM w JOIN h USING (series_id, fold) GROUP BY series_id, alpha)"""


def _enet_one(spark, sf_dir):
    p = scan.row_index(T.panel(spark, sf_dir), "series_id", "t", out="rn", size="n")
    return LI.enet_cv(FO.kfold_contiguous(p, LI.CV_FOLDS), ["tax"], "qty", by="series_id")


@register("m5_enet_one_feature", _ENET_ONE_SQL + "\nSELECT series_id, alpha, mse FROM l",
          [("series_id", "i"), ("alpha", 6), ("mse", 6)])
def m5_enet_one_feature(spark, sf_dir):
    """CV losses of the elastic net on one feature, per series: 10 folds x 100 alphas, against the closed form."""
    return _enet_one(spark, sf_dir)[0]


@register("m6_enet_one_feature", _ENET_ONE_SQL + """,
b AS (SELECT series_id, min({'mse': round(mse, 9), 'alpha': alpha}).alpha AS alpha FROM l GROUP BY series_id),
t AS (SELECT series_id, covar_pop(x, y) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM k GROUP BY series_id),
r AS (SELECT series_id, alpha, mx, my, sign(c) * greatest(abs(c) - 0.5 * alpha, 0) / (v + 0.5 * alpha) AS w
      FROM t JOIN b USING (series_id))
SELECT series_id, w = 0 AS empty, CASE WHEN w <> 0 THEN alpha END AS alpha, w, my - mx * w AS intercept FROM r""",
          [("series_id", "i"), ("empty", "b"), ("alpha", 6), ("w", 6), ("intercept", 6)])
def m6_enet_one_feature(spark, sf_dir):
    """The refit at the best alpha (alphas that leave no weight are one model, so theirs is not compared)."""
    w = F.element_at("coef", 1)
    m = _enet_one(spark, sf_dir)[1]
    return m.select("series_id", (w == 0).alias("empty"), F.when(w != 0, F.col("alpha")).alias("alpha"), w.alias("w"), "intercept")
