"""Linear models from distributed sufficient statistics.

One scan builds the Gram table per group (fold, series, ...); every model is
then solved on its group's p x p statistics inside ``applyInPandas`` (many
groups in parallel; each task holds only p^2 numbers).  Cross-validation
derives the fold-out statistics by subtraction (total - fold) and scores the
held-out fold from its own statistics, so no second pass over the data.

Objective (elastic net): (1/2n)||y - b - Xw||^2 + a*l1*||w||_1 + a*(1-l1)/2*||w||^2,
intercept unpenalised; coordinate descent on the covariance form
(Friedman, Hastie & Tibshirani 2010).
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators.profile import gram
from panelkit.operators.rolling import Keys, _keys, attach
from panelkit.plans.written import written

# Fixed values of the reference's elastic-net set-up
L1_RATIO = 0.5
N_ALPHAS = 100
ALPHA_LOG_RANGE = (-4.0, 2.0)
CV_FOLDS = 10

ALPHA_CHUNK = 25  # alphas that one task solves
NARROW = 8  # up to so many features, problems are solved by the Arrow batch, else one at a time


def alphas_grid(n: int = N_ALPHAS, lo: float = ALPHA_LOG_RANGE[0], hi: float = ALPHA_LOG_RANGE[1]) -> list[float]:
    return [float(10 ** (lo + (hi - lo) * i / (n - 1))) for i in range(n)]


def scaler_fit(df: DataFrame, cols: Sequence[str], by: Keys = ()) -> DataFrame:
    """Mean and population std per column (M2); zero std -> scale 1."""
    ks = _keys(by)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return df.groupBy(*ks).agg(*aggs) if ks else df.agg(*aggs)


def scaler_apply(df: DataFrame, stats: DataFrame, cols: Sequence[str], by: Keys = ()) -> DataFrame:
    ks = _keys(by)
    j = attach(df, stats, ks)
    out = {}
    for c in cols:
        sd = F.col(f"{c}__std")
        scale = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
        out[c] = (F.col(c) - F.col(f"{c}__mean")) / scale
    return j.withColumns(out).drop(*[f"{c}__{s}" for c in cols for s in ("mean", "std")])


def _matrices(g: pd.DataFrame, p: int):
    """Gram rows of one group -> n, means and centred sums of the p+1 columns
    (complete rows, so the diagonal's means hold for all pairs)."""
    m = p + 1
    i, j = g["i"].to_numpy(), g["j"].to_numpy()
    S = np.zeros((m, m))
    S[i, j] = g["cxy"].to_numpy()
    mean = np.zeros(m)
    diag = i == j
    mean[i[diag]] = g["mx"].to_numpy()[diag]
    return float(g["n"].max()), mean, S


def _moments(n, mean, S, p):
    return mean[:p], mean[p], S[:p, :p] / n, S[:p, p] / n


def _joined(a, b):
    """Statistics of the rows of both."""
    (n0, m0, S0), (n, m, S) = a, b
    return n0 + n, (n0 * m0 + n * m) / (n0 + n), S0 + S + np.outer(m - m0, m - m0) * (n0 * n / (n0 + n))


def _without(all_, part):
    """Statistics of all rows but those of ``part``."""
    n, m, S = all_
    nf, mf, Sf = part
    no = n - nf
    mo = (n * m - nf * mf) / no
    return no, mo, S - Sf - np.outer(mf - mo, mf - mo) * (nf * no / n)


def enet_cd(C: np.ndarray, c: np.ndarray, alpha: float, l1: float, w0=None,
            max_iter: int = 10_000, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent on the covariance form; returns w."""
    p = len(c)
    w = np.zeros(p) if w0 is None else w0.copy()
    lam1, lam2 = alpha * l1, alpha * (1 - l1)
    for _ in range(max_iter):
        delta = 0.0
        for j in range(p):
            if C[j, j] + lam2 <= 0:
                continue
            rho = c[j] - C[j] @ w + C[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - lam1, 0.0) / (C[j, j] + lam2)
            delta = max(delta, abs(new - w[j]))
            w[j] = new
        if delta < tol:
            break
    return w


def enet_cd_many(C: np.ndarray, c: np.ndarray, alpha: np.ndarray, l1: float, w0: np.ndarray | None = None,
                 max_iter: int = 10_000, tol: float = 1e-10) -> np.ndarray:
    """``enet_cd`` over a stack of problems at once; each stops by itself."""
    w = np.zeros(c.shape) if w0 is None else w0.copy()
    alpha, live = np.broadcast_to(np.asarray(alpha, float), len(c)), np.arange(len(c))
    for _ in range(max_iter):
        if not len(live):
            break
        Cl, cl, wl, al = C[live], c[live], w[live], alpha[live]
        lam1, lam2, delta = al * l1, al * (1 - l1), np.zeros(len(live))
        for j in range(c.shape[1]):
            den = Cl[:, j, j] + lam2
            rho = cl[:, j] - (Cl[:, j] * wl).sum(1) + Cl[:, j, j] * wl[:, j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - lam1, 0.0) / np.where(den > 0, den, 1.0)
            new = np.where(den > 0, new, wl[:, j])
            delta = np.maximum(delta, np.abs(new - wl[:, j]))
            wl[:, j] = new
        w[live] = wl
        live = live[~(delta < tol)]
    return w


def _solve_ols(C, c):
    return np.linalg.lstsq(C, c, rcond=None)[0]


def fit(df: DataFrame, features: Sequence[str], label: str, by: Keys = (), alpha: float = 0.0,
        l1_ratio: float = L1_RATIO, max_iter: int = 10_000) -> DataFrame:
    """Fit one linear model per group; alpha = 0 is OLS (M4, M6, M7).

    Output: one row per group with ``intercept`` and ``coef`` (array, in
    ``features`` order) and ``n``.
    """
    ks = _keys(by)
    p = len(features)
    data = df.select(*ks, *features, label).dropna()
    g = _packed(gram(data, [*features, label], ks), ks, p)
    kf = [f for f in g.schema.fields if f.name in ks]
    schema = T.StructType(kf + [T.StructField("n", T.DoubleType()), T.StructField("intercept", T.DoubleType()),
                                T.StructField("coef", T.ArrayType(T.DoubleType()))])

    def solve(t: pa.Table) -> pa.Table:
        n, mean, S = _stacked(t, p)
        mx, my, C, c = mean[:, :p], mean[:, p], S[:, :p, :p] / n[:, None, None], S[:, :p, p] / n[:, None]
        w = np.array([_solve_ols(A, v) for A, v in zip(C, c)]).reshape(-1, p) if alpha == 0 else \
            enet_cd_many(C, c, alpha, l1_ratio, max_iter=max_iter)
        return _columns(t, ks, {"n": n, "intercept": my - (mx * w).sum(1), "coef": w})

    return _each(g.where("n > 0"), solve, schema, p)


_STATS = pa.schema([("n", pa.float64()), ("mean", pa.list_(pa.float64())), ("s", pa.list_(pa.float64()))])
_STATS_SQL = "n double, mean array<double>, s array<double>"


def _packed(g: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Gram rows as one row per group: ``n``, the means and the centred sums (row by row)."""
    rows = (g.groupBy(*keys) if keys else g).agg(F.sort_array(F.collect_list(F.struct("i", "j", "n", "mx", "cxy"))).alias("r"))
    diagonal = F.filter("r", lambda r: r["i"] == r["j"])
    return rows.select(*keys, F.array_max("r.n").alias("n"), F.transform(diagonal, lambda r: r["mx"]).alias("mean"),
                       F.col("r.cxy").alias("s"))


def _stats(row: dict, p: int):
    return row["n"], np.array(row["mean"]), np.array(row["s"]).reshape(p + 1, p + 1)


def _stacked(t: pa.Table, p: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n``, means and centred sums of all rows of a packed table."""
    flat = lambda c: pc.list_flatten(t.column(prefix + c)).to_numpy()
    return t.column(prefix + "n").to_numpy(), flat("mean").reshape(-1, p + 1), flat("s").reshape(-1, p + 1, p + 1)


def _columns(t: pa.Table, keys: list[str], values: dict[str, np.ndarray]) -> pa.Table:
    """The keys of ``t`` with new columns; two-dimensional values become arrays."""
    out = t.select(keys)
    for name, v in values.items():
        x = pa.array(np.ascontiguousarray(v).reshape(-1), pa.float64())
        if v.ndim == 2:
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), x)
        out = out.append_column(name, x)
    return out


def _each(df: DataFrame, solve, schema, p: int) -> DataFrame:
    """``solve`` over all rows, each one a problem of its own: by the batch if its statistics are small, else one at a time."""
    if p > NARROW:
        return df.withColumn("pk_id", F.monotonically_increasing_id()).groupBy("pk_id").applyInArrow(solve, schema)

    def batches(it):
        for b in it:
            if b.num_rows:
                yield from solve(pa.Table.from_batches([b])).to_batches()

    return df.mapInArrow(batches, schema)


def _table(rows: list[dict], like: pa.Table, keys: list[str], fields: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([*(like.schema.field(k) for k in keys), *fields]))


def enet_cv(df: DataFrame, features: Sequence[str], label: str, fold: str = "fold",
            by: Keys = (), alphas: Sequence[float] | None = None, l1_ratio: float = L1_RATIO,
            max_iter: int = 10_000, chunk: int = ALPHA_CHUNK) -> tuple[DataFrame, DataFrame]:
    """ElasticNetCV over contiguous folds from one scan (M5) and refit (M6).

    Returns (cv table: group, alpha, mse; model table: group, alpha,
    intercept, coef).  Fold-out statistics = total - fold; the held-out MSE
    is computed from the held-out fold's own statistics.  A task solves
    ``chunk`` neighbouring alphas of one fold, from the largest on with warm
    starts.  Both the packed statistics and the CV result are written once; the
    refit reads them.
    """
    ks, p = _keys(by), len(features)
    alphas = sorted(alphas or alphas_grid())
    data = df.select(*ks, fold, *features, label).dropna(subset=[fold, *features, label])
    data = data.withColumn("pk_fold", F.col(fold)).withColumn("pk_all", F.lit(0))
    gk = [*ks, "pk_all"]
    own = written(_packed(gram(data, [*features, label], [*gk, "pk_fold"]), [*gk, "pk_fold"], p), "cv-stats")
    kf = "".join(f"`{k}` {own.schema[k].dataType.simpleString()}, " for k in gk)
    pair = [("pk_fold", pa.int64()), *((f.name, f.type) for f in _STATS), *((f"out_{f.name}", f.type) for f in _STATS)]

    def leave_out(t: pa.Table) -> pa.Table:
        out = []
        for g in t.to_pylist():
            rows = g["r"]
            folds = [_stats(r, p) for r in rows]
            total = functools.reduce(_joined, folds)
            for r, f in [*zip(rows, folds), ({**rows[0], "pk_fold": None}, None)]:  # no fold: all rows
                n, m, S = total if f is None else _without(total, f)
                out.append({**{k: g[k] for k in gk}, **r, "out_n": n, "out_mean": m.tolist(), "out_s": S.reshape(-1).tolist()})
        return _table(out, t, gk, pair)

    out_sql = ", ".join(f"out_{c}" for c in _STATS_SQL.split(", "))
    groups = own.groupBy(*gk).agg(F.sort_array(F.collect_list(F.struct("pk_fold", "n", "mean", "s"))).alias("r"))
    parts = written(_each(groups, leave_out, f"{kf}pk_fold long, {_STATS_SQL}, {out_sql}", p), "cv-folds")
    chunks = -(-len(alphas) // chunk)
    jobs = parts.where("pk_fold is not null").withColumn("pk_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # every alpha of a chunk, the largest first; the last chunk may hold fewer
    grid = np.full(chunks * chunk, np.nan)
    grid[: len(alphas)] = alphas
    grid = grid.reshape(chunks, chunk)[:, ::-1]

    def solve(t: pa.Table) -> pa.Table:
        (n, mean, S), (nf, mf, Sf) = _stacked(t, p, "out_"), _stacked(t, p)
        mx, my, C, c = mean[:, :p], mean[:, p], S[:, :p, :p] / n[:, None, None], S[:, :p, p] / n[:, None]
        mine, w, out = grid[t.column("pk_chunk").to_numpy()], np.zeros(c.shape), []
        for a in mine.T:  # warm starts
            at = np.flatnonzero(~np.isnan(a))
            w[at] = enet_cd_many(C[at], c[at], a[at], l1_ratio, w[at], max_iter)
            beta, b = np.column_stack([w[at], -np.ones(len(at))]), my[at] - (mx[at] * w[at]).sum(1)
            # held-out SSE of (x.w + b - y) from the fold's statistics
            sse = np.einsum("bi,bij,bj->b", beta, Sf[at], beta) + nf[at] * ((beta * mf[at]).sum(1) + b) ** 2
            out.append(_columns(t.take(pa.array(at)), gk, {"alpha": a[at], "mse": sse / nf[at]}))
        return pa.concat_tables(out)

    losses = _each(jobs, solve, f"{kf}alpha double, mse double", p)
    cv = written(losses.groupBy(*gk, "alpha").agg(F.avg("mse").alias("mse")), "cv-losses")
    best = cv.groupBy(*gk).agg(F.min(F.struct("mse", "alpha"))["alpha"].alias("alpha"))
    whole = attach(parts.where("pk_fold is null"), best, gk)

    def refit(t: pa.Table) -> pa.Table:
        n, mean, S = _stacked(t, p, "out_")
        alpha = t.column("alpha").to_numpy()
        w = enet_cd_many(S[:, :p, :p] / n[:, None, None], S[:, :p, p] / n[:, None], alpha, l1_ratio, max_iter=max_iter)
        return _columns(t, gk, {"alpha": alpha, "intercept": mean[:, p] - (mean[:, :p] * w).sum(1), "coef": w})

    model = _each(whole, refit, f"{kf}alpha double, intercept double, coef array<double>", p)
    return cv.drop("pk_all"), model.drop("pk_all")


def predict(df: DataFrame, model: DataFrame, features: Sequence[str], by: Keys = (),
            out: str = "y_pred") -> DataFrame:
    """x.w + b with the group's coefficients (M10), a JVM expression."""
    ks = _keys(by)
    m = model.select(*ks, "intercept", "coef")
    j = attach(df, m, ks)
    pred = F.col("intercept")
    for i, c in enumerate(features):
        pred = pred + F.col(c) * F.element_at("coef", i + 1)
    return j.withColumn(out, pred).drop("intercept", "coef")


def kkt_violation(C: np.ndarray, c: np.ndarray, w: np.ndarray, alpha: float, l1: float) -> float:
    """Largest violation of the elastic-net optimality conditions."""
    grad = C @ w - c + alpha * (1 - l1) * w
    v = 0.0
    for j in range(len(w)):
        if w[j] != 0:
            v = max(v, abs(grad[j] + alpha * l1 * np.sign(w[j])))
        else:
            v = max(v, max(abs(grad[j]) - alpha * l1, 0.0))
    return v
