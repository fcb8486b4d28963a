"""Walk-forward validation (V4) as grouped DataFrame queries.

All folds of all series are processed together; nothing is looped over on the
driver.  A *fitter* turns the numbered rows and the fold table into what the rest
of the driver needs (``Fitted``).  Two are given:

* ``LinearFitter``: the bounds of all folds cut a series into disjoint segments.
  Every row enters the Gram statistics of its one segment; a running merge over the
  segments gives each fold's fit and train statistics, and with them the model and
  the mean and spread of its train predictions.  No row is copied.
* ``TreeFitter``: boosted trees per (series, fold), fitted on the fit rows and stopped
  by the eval rows.  Training reads a row once per fold it trains, so here rows are
  assigned to folds.

Any object with ``fit(rows, folds, features, label, keys, order)`` may be passed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import series
from panelkit.functions.compat import expm1, safe_div
from panelkit.operators import boost as B
from panelkit.operators import folds as FO
from panelkit.operators import linear as LI
from panelkit.operators import rolling as R
from panelkit.operators import score as S
from panelkit.operators.profile import GRAM_STATS, gram, merge_moments
from panelkit.operators.quantiles import median
from panelkit.operators.rolling import Keys, _keys
from panelkit.plans import scan

RMSE_TAIL, RMSE_BASE, RMSE_MIN_PERIODS = 126, 252, 50
_AT = "pk_at"  # position of a row in its series


@dataclass
class Fitted:
    """``test``: the test rows with ``fold`` and ``y_pred_log`` (NULL without a model).  ``stats``: per (series, fold)
    ``mu`` and ``sigma`` of the train predictions.  ``rmse``: ``rmse_tail, rmse_base, rmse_factor`` of the train
    residuals.  ``models``: ``best_iteration`` (NULL where the fitter has none) and what else the fitter reports."""

    test: DataFrame
    stats: DataFrame
    rmse: DataFrame
    models: DataFrame


class Fitter(Protocol):
    def fit(self, rows: DataFrame, folds: DataFrame, features: Sequence[str], label: str, keys: list[str],
            order: str) -> Fitted: ...


def rmse_table(r: DataFrame, keys: Sequence[str], rn: str, tail: str, base: str) -> DataFrame:
    """tail / base RMSE per group from rolling mean squared residuals: the last tail, the median of base;
    a base that is NULL or 0 becomes max(tail, 1e-6)."""
    a = r.groupBy(*keys).agg(F.sqrt(F.max_by(tail, rn)).alias("rmse_tail"))
    a = R.attach(a, median(r.withColumn("_b", F.sqrt(base)), "_b", keys, "_base"), keys)
    base = F.when(F.col("_base").isNull() | (F.col("_base") == 0),
                  F.greatest(F.col("rmse_tail"), F.lit(1e-6))).otherwise(F.col("_base"))
    return a.select(*keys, "rmse_tail", base.alias("rmse_base"),
                    safe_div("rmse_tail", base).alias("rmse_factor"))


def residual_rmse_factor(train: DataFrame, keys: Sequence[str], rn: str = "rn",
                         resid: str = "resid") -> DataFrame:
    """tail / base RMSE per group (W21): rolling mean e^2 over 126 and 252 rows, min 50."""
    r = train.select(*keys, rn, (F.col(resid) * F.col(resid)).alias("_e2"))
    r = scan.series_pass(r, {"_t": scan.Stat("mean", "_e2", RMSE_TAIL, RMSE_MIN_PERIODS),
                             "_b": scan.Stat("mean", "_e2", RMSE_BASE, RMSE_MIN_PERIODS)}, keys, rn, rn=rn)
    return rmse_table(r, keys, rn, "_t", "_b")


def _test_rows(rows: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """Test rows with their fold: test segments are disjoint, so a row has one fold at most."""
    tests = folds.where("valid").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("test_lo", "test_hi", "fold"))).alias("pk_f"))
    mine = F.filter("pk_f", lambda f: (F.col(_AT) >= f["test_lo"]) & (F.col(_AT) < f["test_hi"]))
    return R.attach(rows, tests, keys).withColumn("fold", F.get(mine, 0)["fold"]).where("fold is not null").drop("pk_f")


@dataclass(frozen=True)
class LinearFitter:
    """OLS (``alpha`` 0) or elastic net on the fit rows; there is nothing to stop early."""

    alpha: float = 0.0
    l1_ratio: float = LI.L1_RATIO
    block_rows: int = scan.DEFAULT_BLOCK_ROWS

    def fit(self, rows, folds, features, label, keys, order) -> Fitted:
        features, p = list(features), len(features)
        used = folds.where("valid")
        bounds = used.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(
            F.array("fit_hi", "train_hi"))))).alias("pk_b"))
        segment = F.size(F.filter("pk_b", lambda b: b <= F.col(_AT)))
        parts = R.attach(rows.select(*keys, _AT, *features, label), bounds, keys).where(F.col(_AT) < F.array_max("pk_b"))
        parts = parts.withColumn("pk_seg", segment.cast("int")).drop(_AT, "pk_b").dropna(subset=[*features, label])
        stats = gram(parts, [*features, label], [*keys, "pk_seg"]).groupBy(*keys, "pk_seg").agg(
            F.sort_array(F.collect_list(F.struct("i", "j", *GRAM_STATS))).alias("s"))
        spans = used.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("fold", "fit_hi", "train_hi"))).alias("pk_f"))
        stats = R.attach(R.attach(stats, bounds, keys), spans, keys)
        kf = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
        models = stats.groupBy(*keys).applyInArrow(self._solve(keys, p), f"{kf}, {_MODEL_SQL}")

        test = _test_rows(rows, folds, keys)
        test = LI.predict(test, models, features, by=[*keys, "fold"], out="y_pred_log")
        e2 = self._errors(rows, models, features, label, keys)
        return Fitted(test, models.select(*keys, "fold", "mu", "sigma"),
                      rmse_table(e2, [*keys, "fold"], _AT, "t", "b"),
                      models.select(*keys, "fold", F.lit(None).cast("long").alias("best_iteration"), "coef", "intercept"))

    def _solve(self, keys: list[str], p: int):
        """One series: merge its segments one after another and solve every fold on the way."""
        def run(t: pa.Table) -> pa.Table:
            rows = sorted(t.to_pylist(), key=lambda r: r["pk_seg"])
            bounds, found = rows[0]["pk_b"], []
            upto, total, at = {}, None, 0
            for s, b in enumerate(bounds):
                while at < len(rows) and rows[at]["pk_seg"] <= s:
                    m = np.zeros((len(GRAM_STATS), p + 1, p + 1))
                    for c in rows[at]["s"]:
                        m[:, c["i"], c["j"]] = [c[k] for k in GRAM_STATS]
                    total, at = m if total is None else merge_moments(total, m), at + 1
                upto[b] = total
            for f in rows[0]["pk_f"]:
                fit, train = upto.get(f["fit_hi"]), upto.get(f["train_hi"])
                if f["fit_hi"] <= 0 or fit is None or fit[0].max() < 1:
                    continue
                n, mean, S = fit[0].max(), fit[1].diagonal(), fit[5]
                mx, my, C, c = LI._moments(n, mean, S, p)
                w = LI._solve_ols(C, c) if self.alpha == 0 else LI.enet_cd(C, c, self.alpha, self.l1_ratio)
                b = my - mx @ w
                spread = w @ train[5][:p, :p] @ w / train[0].max()
                found.append({**{k: rows[0][k] for k in keys}, "fold": f["fold"], "intercept": b, "coef": w.tolist(),
                              "mu": b + train[1].diagonal()[:p] @ w, "sigma": float(np.sqrt(max(spread, 0.0))), "train_hi": f["train_hi"]})
            return pa.Table.from_pylist(found, pa.schema([*(t.schema.field(k) for k in keys), *_MODEL]))
        return run

    def _errors(self, rows, models, features, label, keys) -> DataFrame:
        """``(keys, fold, position, t, b)``: rolling mean squared residuals of every fold's model over its train rows.

        A block of rows arrives once, with the models of its series, and gives the
        narrow result for all folds."""
        p, block_rows = len(features), max(self.block_rows, RMSE_BASE)
        x = F.array(*[F.col(c).cast("double") for c in features], F.col(label).cast("double")).alias("x")
        wide = scan.halo(scan.with_blocks(rows.select(*keys, _AT, x), block_rows, _AT, "pk_blk"), RMSE_BASE, block_rows, _AT,
                         "pk_blk", "pk_home")
        per = models.groupBy(*keys).agg(F.collect_list(F.struct("fold", "train_hi", "intercept", "coef")).alias("m"))
        wide = R.attach(wide, per, keys)
        kf = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

        def run(t: pa.Table) -> pa.Table:
            t = t.take(pa.array(np.argsort(t.column(_AT).to_numpy())))
            at, home = t.column(_AT).to_numpy(), t.column("pk_home").to_numpy().astype(bool)
            v = B._values(t.column("x"), p + 1)
            out = []
            for m in t.column("m")[0].as_py() or []:
                use = at < m["train_hi"]
                if not (use & home).any():
                    continue
                e2 = (v[use, p] - m["intercept"] - v[use, :p] @ np.array(m["coef"])) ** 2
                pick = home[use]
                cols = [series.trailing(e2, k, RMSE_MIN_PERIODS)["mean"][pick] for k in (RMSE_TAIL, RMSE_BASE)]
                n = int(pick.sum())
                out.append(pa.table([*(pa.array([t.column(k)[0].as_py()] * n, t.schema.field(k).type) for k in keys),
                                     pa.array([m["fold"]] * n, pa.int32()), pa.array(at[use][pick]),
                                     *(pa.array(c, pa.float64(), mask=np.isnan(c)) for c in cols)],
                                    names=[*keys, "fold", _AT, "t", "b"]))
            if out:
                return pa.concat_tables(out)
            return pa.schema([*(t.schema.field(k) for k in keys), ("fold", pa.int32()), (_AT, pa.int64()), ("t", pa.float64()),
                              ("b", pa.float64())]).empty_table()

        return wide.groupBy(*keys, "pk_blk").applyInArrow(run, f"{kf}, fold int, {_AT} long, t double, b double")


_MODEL = [("fold", pa.int32()), ("intercept", pa.float64()), ("coef", pa.list_(pa.float64())), ("mu", pa.float64()),
          ("sigma", pa.float64()), ("train_hi", pa.int64())]
_MODEL_SQL = "fold int, intercept double, coef array<double>, mu double, sigma double, train_hi long"


@dataclass(frozen=True)
class TreeFitter:
    """Boosted trees, grown until the eval rows bring no better loss for ``params.patience`` rounds."""

    params: B.Params = B.WALK_FORWARD

    def fit(self, rows, folds, features, label, keys, order) -> Fitted:
        fk = [*keys, "fold"]
        copies = FO.assign_roles(rows, folds, keys, rn=_AT).select(*rows.columns, "fold", "role")
        models = B.fit_groups(copies.where("role <> 'test'"), features, label, fk, params=self.params)
        pred = B.predict_groups(copies, models, features, fk, out="y_pred_log")
        train = pred.where("role <> 'test'").withColumn("resid", F.col(label) - F.col("y_pred_log"))
        return Fitted(pred.where("role = 'test'").drop("role"), S.pred_stats(train, fk, pred="y_pred_log"),
                      residual_rmse_factor(train, fk, rn=_AT), models.select(*fk, "best_iteration"))


def walk_forward(df: DataFrame, features: Sequence[str], label: str, n_splits: int, test_size: int,
                 gap: int = 1, keys: Keys = "series_id", order: str = "t", alpha: float = 0.0,
                 l1_ratio: float = LI.L1_RATIO, vol: str | None = None, regime: str | None = None,
                 fwd: str = "forward_returns", rf: str = "risk_free_rate",
                 fitter: Fitter | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit / predict / position / score every fold; returns (oof, fold_metrics).

    ``label`` is the log target; predictions are mapped back with expm1.
    ``fitter`` is linear (``alpha``, ``l1_ratio``) by default.  The fold table
    has a row for every (series, fold), with ``status`` ok, too_short or
    no_fit_rows; folds without a model keep their out-of-fold rows with NULL
    predictions and positions.
    ``vol`` (e.g. a 21-row rolling std) feeds the vol factor against its
    median over all rows, as in the reference; ``regime`` marks bad regimes.
    """
    ks = _keys(keys)
    fk = [*ks, "fold"]
    base = scan.row_index(df, ks, order, out=_AT)
    placed = base.where(F.col(_AT).isNotNull())
    counts = placed.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"))
    folds = FO.time_folds(counts, n_splits, test_size, gap, ks)
    fitted = (fitter or LinearFitter(alpha, l1_ratio)).fit(placed, folds, features, label, ks, order)
    test = fitted.test
    if vol is not None:
        test = R.attach(test, median(base, vol, ks, "_vm"), ks).withColumn("vol_factor", safe_div(vol, "_vm")).drop("_vm")
    else:
        test = test.withColumn("vol_factor", F.lit(0.0))
    test = R.join_same(test, fitted.rmse.select(*fk, "rmse_factor"), fk)
    pos = S.signal_to_position(test, fitted.stats, fk, pred="y_pred_log", regime=regime)
    pos = pos.withColumn("position", F.when(F.col("y_pred_log").isNotNull(), F.col("position")))
    oof = pos.select(*ks, order, "fold", F.col(label).alias("y_log"), expm1(label).alias("y_arith"),
                     "y_pred_log", expm1("y_pred_log").alias("y_pred_arith"), "position", fwd, rf)

    metrics = S.regression_metrics(test, fk, y=label, yhat="y_pred_log")
    sharpe = S.adjusted_sharpe(oof, fk, position="position", fwd=fwd, rf=rf).select(
        *fk, F.col("adjusted_sharpe"))
    fm = folds.select(*fk, "status")
    for part in (FO.fold_dates(placed, folds, order, ks, _AT), metrics.drop("n"), sharpe, fitted.rmse,
                 fitted.models.select(*fk, "best_iteration")):
        fm = R.join_same(fm, part, fk)
    return oof, fm
