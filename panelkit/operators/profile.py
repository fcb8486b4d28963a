"""Profiling aggregates (F1-F21) and sufficient statistics (M1).

Everything is a grouped aggregate over the long layout ``(keys..., feature,
value)`` or over a grouping column, so one plan serves any number of
features.  Exact quantiles never buffer a whole group in one task (see
``quantiles``); the Gram matrix is built from per-batch partial sums.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions.compat import finite, safe_div
from panelkit.operators.quantiles import exact_quantiles, few, quantile_columns
from panelkit.operators.rolling import Keys, _keys, attach


def _bucket_join_all(grid: DataFrame, bins: DataFrame) -> DataFrame:
    """Grid points x histogram bins of one group: bounded by points x bins."""
    one = F.lit(1).alias("pk_one")
    return grid.select("*", one).join(F.broadcast(bins.select("*", one)), "pk_one").drop("pk_one")


# ----------------------------------------------------------------- moments

def describe(df_long: DataFrame, by: Keys = "feature", value: str = "value") -> DataFrame:
    """count, mean, sample std, min, 25/50/75 %, max per group (F1)."""
    ks = _keys(by)
    v = F.col(value)
    base = df_long.groupBy(*ks).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    qs = exact_quantiles(df_long, value, [0.25, 0.5, 0.75], ks)
    qc = quantile_columns(qs, ks, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return attach(base, qc, ks).select(*ks, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def null_profile(df_long: DataFrame, by: Keys = "feature", value: str = "value",
                 keep_positive: bool = True) -> DataFrame:
    """Null count and percentage per group, only groups with nulls."""
    ks = _keys(by)
    a = df_long.groupBy(*ks).agg(F.count_if(F.col(value).isNull()).alias("null_count"),
                                 F.count(F.lit(1)).alias("rows"))
    a = a.withColumn("null_pct", 100.0 * F.col("null_count") / F.col("rows"))
    return a.where(F.col("null_count") > 0) if keep_positive else a


def null_mask(df_long: DataFrame, time_bucket: Column, by: Keys = "feature",
              value: str = "value") -> DataFrame:
    """Share of NULLs per group and time bucket: heat-map data."""
    ks = _keys(by)
    return (df_long.groupBy(*ks, time_bucket.alias("bucket"))
            .agg(F.avg(F.col(value).isNull().cast("double")).alias("null_share")))


def moments(df: DataFrame, value: str, by: Keys = ()) -> DataFrame:
    """mean, median, std, SNR, bias-corrected skewness G1 and excess kurtosis
    G2, Jarque-Bera (F4-F7)."""
    ks = _keys(by)
    v = F.col(value)
    a = df.groupBy(*ks).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2"))
    med = quantile_columns(exact_quantiles(df, value, [0.5], ks), ks, [0.5], ["median"])
    n = F.col("n").cast("double")
    g1 = F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)
    jb = n / 6 * (F.col("_g1") * F.col("_g1") + F.col("_g2") * F.col("_g2") / 4)
    out = attach(a, med, ks)
    return out.select(*ks, "n", "mean", "median", "std", safe_div("mean", "std").alias("snr"),
                      finite(F.when(n > 2, g1)).alias("skew"),
                      finite(F.when(n > 3, g2)).alias("kurt"), finite(jb).alias("jarque_bera"))


# ----------------------------------------------------------------- distributions

def histogram(df: DataFrame, value: str, bins: int = 200, by: Keys = ()) -> DataFrame:
    """Equal-width histogram between min and max; the max lands in the last bin (F8)."""
    ks = _keys(by)
    mm = df.groupBy(*ks).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    j = df.select(*ks, value).where(F.col(value).isNotNull())
    j = attach(j, few(mm, "ranges") if ks else mm, ks)
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    h = j.groupBy(*ks, b.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    return h.select(*ks, "bin", (F.col("lo") + F.col("bin") * width).alias("left"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("right"), "count")


def kde_curve(df: DataFrame, value: str, points: int = 200, by: Keys = (), bins: int = 1024) -> DataFrame:
    """Gaussian KDE on a grid of ``points`` between each group's extremes.

    Bandwidth: Scott, ``n^(-1/5) * std``.  Every value is shared linearly between the two
    nearest of ``bins`` nodes, which replaces the kernel by its linear interpolation
    between nodes: no density is off by more than ``error_bound`` = ``d^2 / (8 sqrt(2 pi) bw^3)``,
    ``d`` the distance of nodes.  One aggregate over the rows; then nodes x grid points per group.
    A group of equal values has no density (NULL).
    """
    ks = _keys(by)
    x = df.select(*ks, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    st = x.groupBy(*ks).agg(F.count(F.lit(1)).alias("pk_n"), F.min("_v").alias("pk_lo"), F.max("_v").alias("pk_hi"),
                            F.stddev_samp("_v").alias("pk_sd"))
    st = few(st, "ranges") if ks else st
    step = (F.col("pk_hi") - F.col("pk_lo")) / (bins - 1)
    at = F.coalesce(safe_div(F.col("_v") - F.col("pk_lo"), step), F.lit(0.0))
    node = F.least(F.floor(at), F.lit(bins - 2)).cast("int")
    own = attach(x, st.select(*ks, "pk_lo", "pk_hi"), ks).select(*ks, node.alias("pk_k"), (at - node).alias("pk_f"))
    own = own.groupBy(*ks, "pk_k").agg(F.sum(1 - F.col("pk_f")).alias("pk_w0"), F.sum("pk_f").alias("pk_w1"))
    nodes = own.select(*ks, F.explode(F.array(F.struct("pk_k", F.col("pk_w0").alias("pk_w")), F.struct(
        (F.col("pk_k") + 1).alias("pk_k"), F.col("pk_w1").alias("pk_w")))).alias("pk_e")).groupBy(*ks, F.col("pk_e.pk_k").alias("pk_k")).agg(F.sum("pk_e.pk_w").alias("pk_w"))
    bw = F.pow(F.col("pk_n"), F.lit(-0.2)) * F.col("pk_sd")
    grid = st.select(*ks, "pk_n", "pk_lo", step.alias("pk_step"), F.when(F.col("pk_sd") > 0, bw).alias("pk_bw"), "pk_hi",
                     F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    grid = grid.withColumn("g", F.col("pk_lo") + (F.col("pk_hi") - F.col("pk_lo")) * F.col("i") / (points - 1))
    j = attach(grid, nodes, ks) if ks else _bucket_join_all(grid, nodes)
    z = (F.col("g") - (F.col("pk_lo") + F.col("pk_k") * F.col("pk_step"))) / F.col("pk_bw")
    dens = F.sum(F.col("pk_w") * F.exp(-0.5 * z * z)) / (F.col("pk_n") * F.col("pk_bw") * math.sqrt(2 * math.pi))
    bound = F.col("pk_step") * F.col("pk_step") / (8 * math.sqrt(2 * math.pi) * F.pow("pk_bw", 3))
    return j.groupBy(*ks, "i", "g", "pk_n", "pk_bw", "pk_step").agg(dens.alias("density")).select(
        *ks, "i", "g", "density", bound.alias("error_bound"))


def box_stats(df: DataFrame, value: str, by: Keys = ()) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count."""
    ks = _keys(by)
    q = quantile_columns(exact_quantiles(df, value, [0.25, 0.5, 0.75], ks), ks,
                         [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    j = df.select(*ks, value).where(F.col(value).isNotNull())
    j = attach(j, few(q, "quartiles") if ks else q, ks)
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = F.col(value)
    inside = (v >= lo_f) & (v <= hi_f)
    return j.groupBy(*ks, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"))


def sigma_band(df: DataFrame, value: str, k: float = 2.0, by: Keys = ()) -> DataFrame:
    """Flag rows beyond mean +- k sigma of their group."""
    ks = _keys(by)
    st = df.groupBy(*ks).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    j = attach(df, st, ks)
    return j.withColumn("extreme", (F.abs(F.col(value) - F.col("_mu")) > k * F.col("_sd")).cast("int")) \
        .withColumn("band_lo", F.col("_mu") - k * F.col("_sd")) \
        .withColumn("band_hi", F.col("_mu") + k * F.col("_sd")).drop("_mu", "_sd")


def target_correlations(df_long: DataFrame, target: str, by: Keys = "feature",
                        value: str = "value") -> DataFrame:
    """Pearson correlation of every feature with the target."""
    ks = _keys(by)
    return df_long.groupBy(*ks).agg(finite(F.corr(value, target)).alias("corr"))


# ----------------------------------------------------------------- Gram matrix

GRAM_STATS = ("n", "mx", "my", "cxx", "cyy", "cxy")
GRAM_TILE = 256
GRAM_NARROW = 8  # up to so many columns the groups of a batch are summed up together
GRAM_HELD = 1 << 22  # numbers a task keeps before it emits its partial statistics


def _batch_moments(X: np.ndarray, Y: np.ndarray | None = None) -> np.ndarray:
    """Pairwise-complete count, means and centred sums of the columns of one block
    against those of another: 6 x p x q.

    The blocks are shifted by their own column means first, so large offsets do
    not cancel."""
    def centred(A):
        M = ~np.isnan(A)
        mu = np.where(M, A, 0.0).sum(0) / np.maximum(M.sum(0), 1)
        return M.astype("float64"), mu, np.where(M, A - mu, 0.0)

    Mx, mx, Zx = centred(X)
    My, my, Zy = (Mx, mx, Zx) if Y is None else centred(Y)
    n = Mx.T @ My
    d = np.maximum(n, 1.0)
    sx, sy = Zx.T @ My, Mx.T @ Zy
    return np.stack([n, mx[:, None] + sx / d, my[None, :] + sy / d, (Zx * Zx).T @ My - sx * sx / d,
                     Mx.T @ (Zy * Zy) - sy * sy / d, Zx.T @ Zy - sx * sy / d])


def merge_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise update of (n, mx, my, cxx, cyy, cxy), elementwise over arrays."""
    n = a[0] + b[0]
    d = np.maximum(n, 1.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    dx, dy = np.where((a[0] > 0) & (b[0] > 0), dx, 0.0), np.where((a[0] > 0) & (b[0] > 0), dy, 0.0)
    f = a[0] * b[0] / d
    only = a[0] == 0
    return np.stack([n, np.where(only, b[1], a[1] + dx * b[0] / d), np.where(only, b[2], a[2] + dy * b[0] / d),
                     a[3] + b[3] + dx * dx * f, a[4] + b[4] + dy * dy * f, a[5] + b[5] + dx * dy * f])


def gram(df: DataFrame, cols: Sequence[str], by: Keys = (), tile: int = GRAM_TILE) -> DataFrame:
    """Sufficient statistics per group over pairs of ``cols`` (M1).

    Output long table ``(by..., i, j, n, sx, sy, sxx, syy, sxy, mx, my, cxx,
    cyy, cxy)``, pairwise complete; ``m`` are means, ``c`` centred sums.  The unit
    of work is a pair of tiles of up to ``tile`` columns: each pair reads only its
    columns, and a task keeps one centred state of at most ``6 tile^2`` numbers per
    group and emits it once, as one row per (group, i) with arrays over the
    second tile (earlier if it holds ``GRAM_HELD`` numbers); the rows of a
    (group, i, tile) are merged pairwise.  Up to ``GRAM_NARROW`` columns all groups
    of a batch are centred and summed up together, so that a group costs a row, not a Python call.
    """
    if len(cols) <= GRAM_NARROW:
        return _gram_narrow(df, cols, _keys(by))
    tiles = [range(a, min(a + tile, len(cols))) for a in range(0, len(cols), tile)]
    pairs = [_gram_pair(df, cols, a, b, _keys(by)) for k, a in enumerate(tiles) for b in tiles[k:]]
    return functools.reduce(DataFrame.unionByName, pairs)


def _with_lists(keys: pa.Table, values: np.ndarray) -> pa.Table:
    """``keys`` with one array of numbers per row."""
    flat = values.reshape(values.shape[0], -1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1)))
    return keys.append_column("pk_s", lists) if keys.num_columns else pa.table({"pk_s": lists})


def _gram_narrow(df: DataFrame, cols: Sequence[str], ks: list[str]) -> DataFrame:
    """The Gram rows of a few columns: the groups of an Arrow batch are summed up side by side, then merged per group."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    data = df.select(*ks, *[F.col(c).cast("double").alias(f"pk_x{i}") for i, c in enumerate(cols)])
    kf = [f for f in data.schema.fields if f.name in ks]

    def partial(it):
        for b in it:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            code = t.select(ks).to_pandas().groupby(ks, sort=False, dropna=False).ngroup().to_numpy() if ks else np.zeros(t.num_rows, int)
            order = np.argsort(code, kind="stable")
            code = code[order]
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            X = np.column_stack([t.column(f"pk_x{i}").to_numpy() for i in range(len(cols))])[order].astype(float)
            M = ~np.isnan(X)
            total = lambda v: np.add.reduceat(v, starts, axis=0)
            mu = total(np.where(M, X, 0.0)) / np.maximum(total(M.astype(float)), 1)
            M, Z = M.astype(float), np.where(M, X - mu[code], 0.0)  # as in _batch_moments, for all groups
            out = np.empty((len(starts), len(pairs), len(GRAM_STATS)))
            for k, (i, j) in enumerate(pairs):
                n, sx, sy = total(M[:, i] * M[:, j]), total(Z[:, i] * M[:, j]), total(M[:, i] * Z[:, j])
                d = np.maximum(n, 1.0)
                out[:, k] = np.stack([n, mu[:, i] + sx / d, mu[:, j] + sy / d, total(Z[:, i] ** 2 * M[:, j]) - sx * sx / d,
                                      total(Z[:, j] ** 2 * M[:, i]) - sy * sy / d, total(Z[:, i] * Z[:, j]) - sx * sy / d], 1)
            yield from _with_lists(t.select(ks).take(pa.array(order[starts])), out).to_batches()

    def merge(it):
        for b in it:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            parts = t.column("pk_parts").combine_chunks()
            first = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy()))
            x = pc.list_flatten(pc.list_flatten(parts)).to_numpy().reshape(-1, len(pairs), len(GRAM_STATS))
            code = np.repeat(np.arange(len(first) - 1), np.diff(first))
            total = lambda v: np.add.reduceat(v, first[:-1], axis=0)
            n = x[..., 0]
            all_ = total(n)
            some = lambda v: np.where(n > 0, v, 0.0)
            ref = x[first[:-1]][..., 1:3]
            mean = [ref[..., k] + total(n * some(x[..., k + 1] - ref[code][..., k])) / np.maximum(all_, 1.0) for k in (0, 1)]
            dx, dy = (some(x[..., k + 1] - mean[k][code]) for k in (0, 1))
            sums = [total(x[..., k]) + total(n * v) for k, v in ((3, dx * dx), (4, dy * dy), (5, dx * dy))]
            yield from _with_lists(t.select(ks), np.stack([all_, *mean, *sums], -1)).to_batches()

    arr = T.ArrayType(T.DoubleType())
    parts = data.mapInArrow(partial, T.StructType(kf + [T.StructField("pk_s", arr)]))
    g = parts.groupBy(*ks).agg(F.collect_list("pk_s").alias("pk_parts")).where(F.size("pk_parts") > 0)
    g = g.mapInArrow(merge, T.StructType(kf + [T.StructField("pk_s", arr)]))
    where_ = {p: k * len(GRAM_STATS) for k, p in enumerate(pairs)}

    def row(i: int, j: int) -> Column:
        k = where_[min(i, j), max(i, j)]
        n, mx, my, cxx, cyy, cxy = (F.col("pk_s")[k + q] for q in range(len(GRAM_STATS)))
        if i > j:
            mx, my, cxx, cyy = my, mx, cyy, cxx
        values = {"n": n, "sx": n * mx, "sy": n * my, "sxx": cxx + n * mx * mx, "syy": cyy + n * my * my,
                  "sxy": cxy + n * mx * my, "mx": mx, "my": my, "cxx": cxx, "cyy": cyy, "cxy": cxy}
        return F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[v.alias(c) for c, v in values.items()])

    rows = F.explode(F.array(*[row(i, j) for i in range(len(cols)) for j in range(len(cols))]))
    return g.select(*ks, rows.alias("pk_e")).select(*ks, "pk_e.*")


def _gram_pair(df: DataFrame, cols: Sequence[str], first: range, second: range, ks: list[str]) -> DataFrame:
    """The Gram rows of the columns ``first`` against ``second``, and their mirror image if they differ."""
    same = first == second
    kf = [f for f in df.schema.fields if f.name in ks]
    arr = T.ArrayType(T.DoubleType())
    part_schema = T.StructType(kf + [T.StructField("i", T.IntegerType())] + [T.StructField(c, arr) for c in GRAM_STATS])
    raw = ("sx", "sy", "sxx", "syy", "sxy")
    out_schema = T.StructType(kf + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())] +
                              [T.StructField(c, T.DoubleType()) for c in ("n", *raw, *GRAM_STATS[1:])])
    left, right = [f"x{i}" for i in first], [f"x{i}" for i in second]

    def rows_of(state: dict) -> pd.DataFrame:
        recs = [{**dict(zip(ks, key)), "i": i, **{c: m[q, k] for q, c in enumerate(GRAM_STATS)}}
                for key, m in state.items() for k, i in enumerate(first)]
        return pd.DataFrame(recs, columns=[f.name for f in part_schema.fields])

    def partial(it):
        state: dict = {}
        for pdf in it:
            groups = pdf.groupby(ks, sort=False, dropna=False) if ks else [((), pdf)]
            for key, g in groups:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                m = _batch_moments(g[left].to_numpy(dtype="float64"), None if same else g[right].to_numpy(dtype="float64"))
                state[key] = merge_moments(state[key], m) if key in state else m
                if len(state) * m.size > GRAM_HELD and len(state) > 1:
                    yield rows_of(state)
                    state = {}
        if state:
            yield rows_of(state)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        m = None
        for r in pdf.itertuples(index=False):
            x = np.stack([np.asarray(getattr(r, c), dtype="float64") for c in GRAM_STATS])
            m = x if m is None else merge_moments(m, x)
        n, mx, my, cxx, cyy, cxy = m
        out = pd.DataFrame({"j": np.array(second, dtype="int32"), "n": n, "sx": n * mx, "sy": n * my,
                            "sxx": cxx + n * mx * mx, "syy": cyy + n * my * my, "sxy": cxy + n * mx * my,
                            "mx": mx, "my": my, "cxx": cxx, "cyy": cyy, "cxy": cxy})
        for k in [*ks, "i"]:
            out[k] = pdf[k].iloc[0]
        return out[[f.name for f in out_schema.fields]]

    used = dict.fromkeys([*first, *second])
    data = df.select(*ks, *[F.col(cols[i]).cast("double").alias(f"x{i}") for i in used])
    out = data.mapInPandas(partial, part_schema).groupBy(*ks, "i").applyInPandas(merge, out_schema)
    if same:
        return out
    swap = {"i": "j", "j": "i", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx", "mx": "my", "my": "mx", "cxx": "cyy", "cyy": "cxx"}
    both = F.explode(F.array(*[F.struct(*[F.col(m.get(c, c)).alias(c) for c in out.columns if c not in ks]) for m in ({}, swap)]))
    return out.select(*ks, both.alias("pk_e")).select(*ks, *[F.col(f"pk_e.{c}").alias(c) for c in out.columns if c not in ks])


def corr_matrix(df: DataFrame, cols: Sequence[str], by: Keys = ()) -> DataFrame:
    """Pairwise-complete Pearson correlation matrix from the Gram table."""
    ks = _keys(by)
    g = gram(df, cols, ks)
    names = F.array(*[F.lit(c) for c in cols])
    den = F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy"))
    return g.select(*ks, F.element_at(names, F.col("i") + 1).alias("feature_a"),
                    F.element_at(names, F.col("j") + 1).alias("feature_b"),
                    F.col("n").cast("long").alias("n"),
                    F.when(F.col("n") > 1, safe_div("cxy", den)).alias("corr"))


def fit_line(df: DataFrame, x: str, y: str, by: Keys = (), points: int = 200) -> DataFrame:
    """Least-squares slope / intercept and a prediction grid."""
    ks = _keys(by)
    a = df.groupBy(*ks).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                            F.min(x).alias("lo"), F.max(x).alias("hi"))
    g = a.select(*ks, "slope", "intercept", "lo", "hi",
                 F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    gx = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(points - 1)
    return g.select(*ks, "slope", "intercept", "i", gx.alias("x"),
                    (F.col("intercept") + F.col("slope") * gx).alias("y_fit"))
