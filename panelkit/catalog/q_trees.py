"""Registered queries: boosted trees (M8, M9, M11, C4) with the reference's rounds, rates and patience.

Rows-only: a forest has no SQL twin; tests hold the models against quality bands on planted signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.catalog.spec import register
from panelkit.operators import boost as B
from panelkit.operators import features as FE
from panelkit.plans import scan
from panelkit.plans.written import written
from panelkit.sources import tables as T

FEATS = ["f_lag1", "f_lag2", "f_mean5", "f_std21", "f_disc", "f_tax", "f_qty"]


def _data(spark, sf_dir):
    """The market series with features, its row position, and the bounds of the test and eval rows."""
    m = FE.target_log(T.market(spark, sf_dir), out="y")
    m = scan.series_pass(scan.row_index(m, "series_id", "t", out="rn"), {
        "f_lag1": scan.Stat("lag", "y", 1), "f_lag2": scan.Stat("lag", "y", 2),
        "f_mean5": scan.Stat("mean", "y", 5, 1, shift=1), "f_std21": scan.Stat("std", "y", 21, 1, shift=1)}, rn="rn")
    m = m.withColumns({"f_disc": F.col("disc"), "f_tax": F.col("tax"), "f_qty": F.col("qty").cast("double")})
    m = written(m.withColumns({c: F.coalesce(F.col(c), F.lit(FE.SENTINEL)) for c in FEATS}).select("t", "rn", "y", *FEATS), "trees")
    n = m.agg(F.max("rn")).first()[0] + 1
    cut = int(n * 0.8)
    return m, cut, cut - max(min(cut // 5, 252), 50)


@register("m8_gbt_predict", None, [("t", "date"), ("y", 8), ("y_pred", 8)])
def m8_gbt_predict(spark, sf_dir):
    """Boosted trees (500 rounds, depth 5, rate 0.05, 70 % of rows and features) fit on the
    first 80 % of the market series, predictions on the rest."""
    m, cut, _ = _data(spark, sf_dir)
    model = B.fit(m.where(F.col("rn") < cut), FEATS, "y", B.BATCH)
    return B.predict(model, m.where(F.col("rn") >= cut)).select("t", "y", "y_pred")


@register("m9_gbt_early_stopping", None, [("best_rounds", "i"), ("valid_mse", 8), ("test_mse", 8)])
def m9_gbt_early_stopping(spark, sf_dir):
    """Up to 5 000 rounds, stopped once 100 rounds brought no better loss on the eval tail."""
    m, cut, ev = _data(spark, sf_dir)
    fit_rows, eval_rows = m.where(F.col("rn") < ev), m.where((F.col("rn") >= ev) & (F.col("rn") < cut))
    model = B.fit(fit_rows, FEATS, "y", B.WALK_FORWARD, eval_rows)
    p = B.predict(model, m.where(F.col("rn") >= ev)).withColumn("e", F.pow(F.col("y") - F.col("y_pred"), 2))
    return p.agg(F.lit(len(model.trees)).alias("best_rounds"), F.avg(F.when(F.col("rn") < cut, F.col("e"))).alias("valid_mse"),
                 F.avg(F.when(F.col("rn") >= cut, F.col("e"))).alias("test_mse"))


@register("m11_c4_feature_importance", None, [("feature", "s"), ("importance", 8), ("splits", "i")])
def m11_c4_feature_importance(spark, sf_dir):
    """Top-20 features by their share of the average gain, with split counts, of the 500-round model."""
    m, cut, _ = _data(spark, sf_dir)
    return B.importances(spark, B.fit(m.where(F.col("rn") < cut), FEATS, "y", B.BATCH), top=20)
