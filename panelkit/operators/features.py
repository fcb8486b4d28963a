"""Feature pipelines.

Wide operators (``momentum``, ``volatility``) add a fixed set of columns to a
panel.  The per-feature extension (``extend_long``) works on the long layout
``(series_id, t, feature, value)``: windows are partitioned by (series,
feature), so the plan has a constant number of expressions whatever the
number of base features, and parallelism is series x features.

Data-dependent schemas (missing flags, guards) are two-phase: one small
aggregate decides the column / feature list, then a projection applies it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions.compat import finite, flag, safe_div, sentinel, log1p
from panelkit.operators import rolling as R
from panelkit.operators.quantiles import exact_quantiles
from panelkit.operators.rolling import Keys, _keys
from panelkit.plans import scan

# Fixed values of the reference pipeline
SENTINEL = -9999.0
WINDOWS = (5, 10, 21, 63, 126, 252)
LAGS = (1, 2, 3, 5, 10, 21, 63, 126)
EMA_SPANS = {"ema_fast": 10, "ema_slow": 50}
_EMA_ALPHAS = {n: scan.alpha_of(span=s) for n, s in EMA_SPANS.items()}
EXCLUDED = ("date", "date_id", "forward_returns", "risk_free_rate",
            "market_forward_excess_returns", "log_market_forward_excess_returns")
HIGHVOL_RATIO = 1.2
SHOCK_Z = 2.5
BULL_SMA = 200
INTERACTED = ("MOM_ema_diff", "MOM_roc_21", "MOM_mean_21")
VARIANCE_FLOOR = 1e-10
EXAMPLE_KEEP = ("S2", "E2", "E3", "P9", "S1", "S5", "I2", "P8", "P10", "P12", "P13", "U1", "U2")


def target_log(df: DataFrame, arith: str = "market_forward_excess_returns",
               out: str = "log_market_forward_excess_returns") -> DataFrame:
    """log1p of the arithmetic target (B10); <= -1 -> NULL."""
    return df.withColumn(out, log1p(arith))


def category_groups(columns: Sequence[str], excluded: Sequence[str] = EXCLUDED) -> dict[str, list[str]]:
    """First-letter groups of feature names (B5), in column order."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        if c in excluded or not c or not c[0].isalpha():
            continue
        groups.setdefault(c[0], []).append(c)
    return groups


def category_catalogue(df_long: DataFrame, feature: str = "feature") -> DataFrame:
    """Distributed form of B5 over a long panel: (group, features)."""
    f = df_long.select(feature).distinct()
    return (f.where(F.col(feature).rlike("^[A-Za-z]"))
            .groupBy(F.substring(feature, 1, 1).alias("group"))
            .agg(F.sort_array(F.collect_list(feature)).alias("features")))


def momentum(df: DataFrame, target: str = "log_market_forward_excess_returns",
             keys: Keys = "series_id", order: str = "t", fill: float = SENTINEL,
             windows: Sequence[int] = WINDOWS, lags: Sequence[int] = LAGS,
             block_rows: int = scan.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """37 momentum columns on the target shifted by one row; NULL -> fill."""
    outs = scan.shifted_stats(target, windows, lags, None, "MOM_", ewms=_EMA_ALPHAS)
    return _momentum_columns(scan.series_pass(df, outs, keys, order, block_rows), fill, windows, lags)


def _momentum_columns(s: DataFrame, fill: float, windows: Sequence[int] = WINDOWS, lags: Sequence[int] = LAGS) -> DataFrame:
    s = s.withColumns({
        "MOM_ema_diff": F.col("MOM_ema_fast") - F.col("MOM_ema_slow"),
        "MOM_ema_ratio": safe_div("MOM_ema_fast", "MOM_ema_slow") - 1,
        "MOM_std_21_252_ratio": safe_div("MOM_std_21", "MOM_std_252"),
    })
    return s.withColumns({n: sentinel(n, fill) for n in momentum_names(windows, lags)})


def momentum_names(windows: Sequence[int] = WINDOWS, lags: Sequence[int] = LAGS) -> list[str]:
    names = []
    for k in windows:
        names += [f"MOM_mean_{k}", f"MOM_std_{k}", f"MOM_roc_{k}", f"MOM_cum_{k}"]
    names += ["MOM_ema_fast", "MOM_ema_slow", "MOM_ema_diff", "MOM_ema_ratio", "MOM_std_21_252_ratio"]
    return names + [f"MOM_lag_{j}" for j in lags]


def volatility(df: DataFrame, target: str = "log_market_forward_excess_returns",
               keys: Keys = "series_id", order: str = "t", first_fill: float = SENTINEL,
               block_rows: int = scan.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Regime indicators and interactions over the (filled) P1 columns.

    ``first_fill`` is the value used for the missing first shifted target in
    the wealth curve: ``-9999`` reproduces the reference (whose curve is then
    negative and the bull flag inverted), ``0.0`` gives the intended curve.
    """
    s = _wealth(df, target, keys, order, first_fill)
    s = scan.series_pass(s, {**_regime_stats(target), "_v1": scan.Stat("lag", "MOM_std_21", 1)}, keys, order, block_rows)
    return _volatility_columns(s)


def momentum_volatility(df: DataFrame, target: str = "log_market_forward_excess_returns", keys: Keys = "series_id",
                        order: str = "t", fill: float = SENTINEL, first_fill: float = SENTINEL,
                        block_rows: int = scan.DEFAULT_BLOCK_ROWS, longest: int | None = None,
                        extend: Sequence[str] = (), extend_fill: float | None = None) -> DataFrame:
    """P1 and P2 together: one running product, then one pass over the series for all windows.

    The same pass gives P4 of the columns ``extend`` in the wide layout, ``{column}_{statistic}``: what ``extend_long``
    gives between ``to_long`` and ``to_wide``, without moving the rows there and back.  ``extend_fill`` stands for
    NULLs that the extension sees.  ``longest`` is the longest series' length, where it is known."""
    longest = scan.longest_series(df, keys, order) if longest is None else longest
    seen = {c: f"pk_seen_{c}" for c in extend}
    value = lambda c: F.col(c).cast("double")
    s = df.withColumns({n: value(c) if extend_fill is None else F.coalesce(value(c), F.lit(float(extend_fill)))
                        for c, n in seen.items()})
    s = _wealth(s, target, keys, order, first_fill, longest, block_rows if longest <= block_rows else None)
    outs = {**scan.shifted_stats(target, WINDOWS, LAGS, None, "MOM_", ewms=_EMA_ALPHAS), **_regime_stats(target)}
    for c, n in seen.items():
        outs.update(_extension_stats(n, f"{c}_"))
    s = _momentum_columns(scan.series_pass(s, outs, keys, order, block_rows, longest=longest).drop(*seen.values()), fill)
    for c in extend:
        s = _extension_columns(s, fill, f"{c}_")
    # MOM_std_21 of the row before, filled as P1 fills it; the first row has none before
    return _volatility_columns(s.withColumn("_v1", F.when(F.col("_has").isNotNull(), sentinel("_sd", fill))))


def _wealth(df: DataFrame, target: str, keys: Keys, order: str, first_fill: float, longest: int | None = None,
            span: int | None = None) -> DataFrame:
    """The target one row earlier, and the wealth curve over it."""
    return scan.carry(df, {"_s": ("lag", target), "_has": ("lag", F.lit(1))},
                      {"_mkt": ("product", 1 + F.coalesce(F.col("_s"), F.lit(float(first_fill))))}, keys=keys, order=order,
                      span=span or 1024, longest=longest)


def _regime_stats(target: str) -> dict:
    return {"_sd": scan.Stat("std", target, 21, shift=2), "_sma": scan.Stat("mean", "_mkt", BULL_SMA)}


def _volatility_columns(s: DataFrame) -> DataFrame:
    s = s.withColumns({
        "VI_regime_highvol": flag(F.col("MOM_std_21_252_ratio") > HIGHVOL_RATIO, "tinyint"),
        # |s / sd| > z without a division: sd = 0 and s != 0 counts (inf > z)
        "VI_regime_shock": flag(F.abs("_s") > SHOCK_Z * F.col("_sd"), "tinyint"),
        "VI_regime_bull": flag(F.col("_mkt") > F.col("_sma"), "tinyint"),
        "VI_volofvol_21": F.coalesce(safe_div("MOM_std_21", "_v1") - 1, F.lit(0.0)),
    })
    inter = {}
    for c in INTERACTED:
        if c in s.columns:
            inter[f"VI_{c}_x_bull"] = F.col(c) * F.col("VI_regime_bull")
            inter[f"VI_{c}_x_highvol"] = F.col(c) * F.col("VI_regime_highvol")
    ema = F.col("MOM_ema_diff") if "MOM_ema_diff" in s.columns else F.lit(0.0)
    inter["VI_regime_highvol_x_ema"] = F.col("VI_regime_highvol") * ema
    return s.withColumns(inter).drop("_s", "_has", "_sd", "_v1", "_mkt", "_sma")


def volatility_names() -> list[str]:
    names = ["VI_regime_highvol", "VI_regime_shock", "VI_regime_bull", "VI_volofvol_21"]
    for c in INTERACTED:
        names += [f"VI_{c}_x_bull", f"VI_{c}_x_highvol"]
    return names + ["VI_regime_highvol_x_ema"]


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F2 in one pass: one row of null counts (wide)."""
    return df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def impute(df: DataFrame, fill: float = SENTINEL, excluded: Sequence[str] = EXCLUDED,
           keys: Sequence[str] = ("series_id", "t"), counted: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """``{c}_is_missing`` for columns with any NULL, then NULL -> fill.

    Phase 1 is one aggregate returning a single row of counts (size = number
    of columns); phase 2 is a projection.  Returns (frame, flag columns).  Columns that
    cannot be NULL by their schema are not counted; if ``counted`` (the same rows, before
    columns were added) holds all others, it is counted instead.
    """
    feats = [c for c in df.columns if c not in excluded and c not in keys]
    may = [c for c in feats if df.schema[c].nullable]
    source = counted if counted is not None and set(may) <= set(counted.columns) else df
    cnt = null_counts(source, may).first().asDict()
    with_nulls = [c for c in may if cnt[c] > 0]
    flags = {f"{c}_is_missing": F.col(c).isNull().cast("int") for c in with_nulls}
    out = df.withColumns(flags).withColumns({c: F.coalesce(F.col(c), F.lit(float(fill)))
                                             for c in feats})
    return out, list(flags)


def to_long(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("series_id", "t"),
            feature: str = "feature", value: str = "value") -> DataFrame:
    """Unpivot features into (keys..., feature, value); NULL values are kept.  As a generator, which leaves rows that lie
    together by the keys so for what follows (``unpivot`` does not, and they would be moved again as long rows)."""
    rows = [F.struct(F.lit(c).alias(feature), F.col(c).cast("double").alias(value)) for c in features]
    return df.select(*keys, F.inline(F.array(*rows)))


def to_wide(df_long: DataFrame, features: Sequence[str], stat_cols: Sequence[str],
            keys: Sequence[str] = ("series_id", "t"), feature: str = "feature",
            name_fmt: str = "{feature}_{stat}") -> DataFrame:
    """Pivot selected features back to columns with an explicit feature list."""
    aggs = [F.first(c).alias(c) for c in stat_cols]
    p = df_long.groupBy(*keys).pivot(feature, list(features)).agg(*aggs)
    ren = {}
    for f in features:
        for c in stat_cols:
            src = f"{f}_{c}" if len(stat_cols) > 1 else f
            ren[src] = name_fmt.format(feature=f, stat=c)
    return p.withColumnsRenamed(ren)


def extension_names(windows: Sequence[int] = WINDOWS, lags: Sequence[int] = LAGS) -> list[str]:
    names = []
    for k in windows:
        names += [f"mean_{k}", f"std_{k}", f"roc_{k}", f"cum_{k}"]
    names += [f"lag_{j}" for j in lags]
    return names + ["ema_fast", "ema_slow", "ema_diff", "ema_ratio"]


def extend_long(df_long: DataFrame, keys: Keys = "series_id", order: str = "t",
                feature: str = "feature", value: str = "value", fill: float = SENTINEL,
                windows: Sequence[int] = WINDOWS, lags: Sequence[int] = LAGS, min_periods: int = 5,
                rn: str | None = None, block_rows: int = scan.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """P4 on the long layout: 36 statistics per (series, t, feature) row.

    ``u = lag(value, 1)``; rolling mean/std/sum with ``min_periods``; roc on
    u; lags ``lag(u, j-1)``; EWM fast/slow on u; NULL/non-finite -> fill.
    """
    outs = _extension_stats(value, "", windows, lags, min_periods)
    return _extension_columns(scan.series_pass(df_long, outs, [*_keys(keys), feature], order, block_rows, rn), fill, "", windows, lags)


def _extension_stats(value: str, prefix: str, windows: Sequence[int] = WINDOWS, lags: Sequence[int] = LAGS,
                     min_periods: int = 5) -> dict[str, scan.Stat | scan.Ewm]:
    return scan.shifted_stats(value, windows, lags, min_periods, prefix, ewms=_EMA_ALPHAS)


def _extension_columns(d: DataFrame, fill: float, prefix: str, windows: Sequence[int] = WINDOWS,
                       lags: Sequence[int] = LAGS) -> DataFrame:
    fast, slow = f"{prefix}ema_fast", f"{prefix}ema_slow"
    d = d.withColumns({f"{prefix}ema_diff": F.col(fast) - F.col(slow), f"{prefix}ema_ratio": safe_div(fast, slow) - 1})
    return d.withColumns({f"{prefix}{n}": sentinel(f"{prefix}{n}", fill) for n in extension_names(windows, lags)})


def guard_stats(df_long: DataFrame, feature: str = "feature", value: str = "value",
                fill: float = SENTINEL) -> DataFrame:
    """P5 phase 1 on the long layout: min, max, population variance per feature."""
    v = sentinel(value, fill)
    return df_long.groupBy(feature).agg(F.min(v).alias("vmin"), F.max(v).alias("vmax"),
                                        F.var_pop(v).alias("var_pop"))


def guard_keep(stats: DataFrame, threshold: float = VARIANCE_FLOOR) -> DataFrame:
    """Features that are not constant and have population variance > threshold."""
    return stats.where((F.col("vmin") != F.col("vmax")) & (F.col("var_pop") > threshold))


def guard_long(df_long: DataFrame, feature: str = "feature", value: str = "value",
               fill: float = SENTINEL, threshold: float = VARIANCE_FLOOR) -> DataFrame:
    """P5 on the long layout: keep guarded features only (a semi join, no action)."""
    keep = guard_keep(guard_stats(df_long, feature, value, fill), threshold).select(feature)
    # one row per feature name: broadcast, or the rows of a feature would all meet in one task
    return (df_long.join(F.broadcast(keep), feature, "left_semi")
            .withColumn(value, sentinel(value, fill)))


def guard_wide(df: DataFrame, fill: float = SENTINEL, excluded: Sequence[str] = EXCLUDED,
               keys: Sequence[str] = ("series_id", "t"),
               threshold: float = VARIANCE_FLOOR) -> DataFrame:
    """P5 on a wide frame: numeric only, non-finite -> fill, drop constant and
    near-constant columns; excluded columns first (B4 + U6 + F19 + F20)."""
    ex = [c for c in [*keys, *excluded] if c in df.columns]
    num = [f.name for f in df.schema.fields if f.name not in ex
           and isinstance(f.dataType, T.NumericType)]
    filled = df.select(*ex, *[sentinel(c, fill).alias(c) for c in num])
    # one group per column, as aggregates of many columns side by side make one very long generated method
    st = (filled.select(F.posexplode(F.array(*num)).alias("pk_i", "pk_v")).groupBy("pk_i")
          .agg(F.min("pk_v").alias("mn"), F.max("pk_v").alias("mx"), F.var_pop("pk_v").alias("v")).collect()) if num else []
    kept = {r.pk_i for r in st if r.mn != r.mx and (r.v or 0.0) > threshold}
    return filled.select(*ex, *[c for i, c in enumerate(num) if i in kept])


def add_date(df: DataFrame, start: str = "1990-01-01", position: str = "rn",
             out: str = "date") -> DataFrame:
    """Business-day calendar from a 0-based position column."""
    from panelkit.functions.calendar import business_day
    return df.withColumn(out, business_day(position, start))


def example_dataset(df: DataFrame, keys: Keys = "series_id", order: str = "t",
                    target: str = "target", keep: Sequence[str] = EXAMPLE_KEEP,
                    block_rows: int = scan.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """U1 = I2 - I1, U2 = M11 / mean(I2, I9, I7); keep 13 features; fill
    each NULL with the column's EWM (com 0.5, adjust=True), all in one pass; drop
    rows whose target or features still hold a NULL (a NULL key or time is none)."""
    ks = _keys(keys)
    d = df.withColumns({"U1": F.col("I2") - F.col("I1"),
                        "U2": safe_div("M11", (F.col("I2") + F.col("I9") + F.col("I7")) / 3)})
    d = d.select(*ks, order, target, *keep)
    a = scan.alpha_of(com=0.5)
    e = scan.series_pass(d, {f"pk_e_{c}": scan.Ewm(c, a, adjust=True) for c in keep}, ks, order, block_rows)
    e = e.withColumns({c: F.coalesce(F.col(c), F.col(f"pk_e_{c}")) for c in keep})
    return e.select(*ks, order, target, *keep).dropna(subset=[target, *keep])


def first_complete(df: DataFrame, features: Sequence[str], keys: Keys = "series_id",
                   order: str = "t") -> DataFrame:
    """Keep rows from the first date on which every feature has started."""
    ks = _keys(keys)
    starts = df.groupBy(*ks).agg(F.greatest(*[F.min(F.when(F.col(c).isNotNull(), F.col(order)))
                                              for c in features]).alias("_start")) \
        if len(features) > 1 else df.groupBy(*ks).agg(
            F.min(F.when(F.col(features[0]).isNotNull(), F.col(order))).alias("_start"))
    return R.attach(df, starts, ks).where(F.col(order) >= F.col("_start")).drop("_start")


def impute_expanding_mean(df: DataFrame, features: Sequence[str], keys: Keys = "series_id",
                          order: str = "t") -> DataFrame:
    """P9 without look-ahead: NULL -> mean of the earlier rows of the series."""
    w = R.series_window(keys, order)
    return df.withColumns({c: F.coalesce(F.col(c), R.expanding_mean(c, w)) for c in features})


def impute_global_median(df: DataFrame, features: Sequence[str], keys: Keys = "series_id") -> DataFrame:
    """P9 research mode (looks ahead): NULL -> the series' median."""
    ks = _keys(keys)
    lng = to_long(df, features, ks, "pk_feature", "pk_value")
    half = exact_quantiles(lng, "pk_value", [0.5], [*ks, "pk_feature"])
    med = half.groupBy(*ks).agg(*[F.max(F.when(F.col("pk_feature") == c, F.col("quantile"))).alias(f"_m_{c}") for c in features])
    j = R.attach(df, med, ks)
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in features}).drop(
        *[f"_m_{c}" for c in features])
