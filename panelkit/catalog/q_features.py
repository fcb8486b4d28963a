"""Registered queries: EWM and feature pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.catalog import ctes
from panelkit.catalog import sqlgen as G
from panelkit.catalog.spec import register
from panelkit.operators import features as FE
from panelkit.operators import rolling as R
from panelkit.plans import scan
from panelkit.sources import tables as T

KEY = [("series_id", "i"), ("t", "date")]


def _digits(name: str) -> int:
    """Ratios of near-zero quantities are compared with fewer decimals."""
    return 3 if ("roc" in name or "ratio" in name or "volofvol" in name) else 6
A_FAST, A_SLOW, A_COM = 2.0 / 11.0, 2.0 / 51.0, 1.0 / 1.5


# ----------------------------------------------------------------- EWM

@register("w6_ewm_adjust_false",
          G.recursive(ctes.PANEL + ctes.GAPS + ",\nsrc AS (SELECT series_id, t, E1 FROM panel_gaps)"
                      + G.ewm_ctes("src", "E1", {"e1_ema_fast": A_FAST, "e1_ema_slow": A_SLOW})
                      + "\nSELECT series_id, t, e1_ema_fast, e1_ema_slow, "
                        "e1_ema_fast - e1_ema_slow AS e1_ema_diff, "
                      + G.sdiv("e1_ema_fast", "e1_ema_slow") + " - 1 AS e1_ema_ratio FROM ewm"),
          KEY + [("e1_ema_fast", 6), ("e1_ema_slow", 6), ("e1_ema_diff", 6), ("e1_ema_ratio", 3)])
def w6_ewm_adjust_false(spark, sf_dir):
    """EWM spans 10 / 50 (adjust=False) over a column with scattered NULLs."""
    g = T.panel_gaps(spark, sf_dir).select("series_id", "t", "E1")
    e = scan.ewm(g, "E1", {"e1_ema_fast": A_FAST, "e1_ema_slow": A_SLOW}, adjust=False)
    from panelkit.functions.compat import safe_div
    return e.select("series_id", "t", "e1_ema_fast", "e1_ema_slow",
                    (F.col("e1_ema_fast") - F.col("e1_ema_slow")).alias("e1_ema_diff"),
                    (safe_div("e1_ema_fast", "e1_ema_slow") - 1).alias("e1_ema_ratio"))


@register("w7_ewm_adjust_true",
          G.recursive(ctes.PANEL + ctes.GAPS + ",\nsrc AS (SELECT series_id, t, P1 FROM panel_gaps)"
                      + G.ewm_ctes("src", "P1", {"p1_ewm_com05": A_COM}, adjust=True)
                      + "\nSELECT series_id, t, p1_ewm_com05 FROM ewm"),
          KEY + [("p1_ewm_com05", 4)])
def w7_ewm_adjust_true(spark, sf_dir):
    """EWM com 0.5 (adjust=True) over a column that starts late."""
    g = T.panel_gaps(spark, sf_dir).select("series_id", "t", "P1")
    return scan.ewm(g, "P1", {"p1_ewm_com05": A_COM}, adjust=True).select(
        "series_id", "t", "p1_ewm_com05")


# ----------------------------------------------------------------- P1 / P2

_TARGET_SQL = ctes.PANEL + """,
tl AS (SELECT series_id, t, forward_returns, risk_free_rate, """ + G.log1p("market_forward_excess_returns") + """ AS y
       FROM panel)"""


def _p1_sql(source: str = _TARGET_SQL) -> str:
    """P1 over ``tl(series_id, t, forward_returns, risk_free_rate, y)``."""
    cols = []
    for k in FE.WINDOWS:
        cols += [f"{G.roll('avg', 's', k)} AS MOM_mean_{k}",
                 f"{G.roll('stddev_samp', 's', k)} AS MOM_std_{k}",
                 f"{G.sdiv('s', G.lag('s', k))} - 1 AS MOM_roc_{k}",
                 f"{G.roll('sum', 's', k)} AS MOM_cum_{k}"]
    cols += [f"{G.lag('y', j)} AS MOM_lag_{j}" for j in FE.LAGS]
    names = FE.momentum_names()
    filled = ", ".join(f"coalesce({G.fin(n)}, -9999.0) AS {n}" for n in names)
    return (source + """,
sh AS (SELECT *, lag(y, 1) OVER (PARTITION BY series_id ORDER BY t) AS s FROM tl)"""
            + G.ewm_ctes("sh", "s", {"MOM_ema_fast": A_FAST, "MOM_ema_slow": A_SLOW}) + f""",
f AS (SELECT *, {', '.join(cols)} FROM ewm),
g AS (SELECT *, MOM_ema_fast - MOM_ema_slow AS MOM_ema_diff,
             {G.sdiv('MOM_ema_fast', 'MOM_ema_slow')} - 1 AS MOM_ema_ratio,
             {G.sdiv('MOM_std_21', 'MOM_std_252')} AS MOM_std_21_252_ratio FROM f),
p1 AS (SELECT series_id, t, y, s, forward_returns, risk_free_rate, {filled} FROM g)""")


def _target(spark, sf_dir):
    return FE.target_log(T.panel(spark, sf_dir)).select("series_id", "t", "log_market_forward_excess_returns")


@register("p1_momentum",
          G.recursive(_p1_sql() + "\nSELECT series_id, t, " + ", ".join(FE.momentum_names()) + " FROM p1"),
          KEY + [(n, _digits(n)) for n in FE.momentum_names()])
def p1_momentum(spark, sf_dir):
    """37 momentum columns of the log target, shifted by one row, NULL -> -9999."""
    return FE.momentum(_target(spark, sf_dir)).select("series_id", "t", *FE.momentum_names())


def _p2_sql(first_fill: float) -> str:
    inter = []
    for c in FE.INTERACTED:
        inter += [f"{c} * VI_regime_bull AS VI_{c}_x_bull", f"{c} * VI_regime_highvol AS VI_{c}_x_highvol"]
    return _p1_sql() + f""",
p2a AS (SELECT *, lag(s, 1) OVER (PARTITION BY series_id ORDER BY t) AS s1,
               product(1 + coalesce(s, {first_fill})) OVER {G.win()} AS mkt FROM p1),
p2b AS (SELECT *, CASE WHEN MOM_std_21_252_ratio > 1.2 THEN 1 ELSE 0 END AS VI_regime_highvol,
               CASE WHEN abs(s) > 2.5 * ({G.roll('stddev_samp', 's1', 21)}) THEN 1 ELSE 0 END AS VI_regime_shock,
               CASE WHEN mkt > ({G.roll('avg', 'mkt', 200)}) THEN 1 ELSE 0 END AS VI_regime_bull,
               coalesce({G.sdiv('MOM_std_21', G.lag('MOM_std_21', 1))} - 1, 0) AS VI_volofvol_21
        FROM p2a)
SELECT series_id, t, VI_regime_highvol, VI_regime_shock, VI_regime_bull, VI_volofvol_21,
       {', '.join(inter)}, VI_regime_highvol * MOM_ema_diff AS VI_regime_highvol_x_ema
FROM p2b"""


_P2_OUT = KEY + [(n, "i") for n in FE.volatility_names()[:3]] + [(n, _digits(n)) for n in FE.volatility_names()[3:]]


@register("p2_volatility_faithful", G.recursive(_p2_sql(-9999.0)), _P2_OUT)
def p2_volatility_faithful(spark, sf_dir):
    """Regime indicators with the reference's -9999 first fill of the wealth curve."""
    return FE.momentum_volatility(_target(spark, sf_dir)).select("series_id", "t", *FE.volatility_names())


@register("p2_volatility_corrected", G.recursive(_p2_sql(0.0)), _P2_OUT)
def p2_volatility_corrected(spark, sf_dir):
    """Regime indicators with the wealth curve starting at 1 (first fill 0)."""
    return FE.momentum_volatility(_target(spark, sf_dir), first_fill=0.0).select("series_id", "t", *FE.volatility_names())


@register("b10_target_log",
          ctes.PANEL + "\nSELECT series_id, t, ln(1 + market_forward_excess_returns) AS y_log, "
          "exp(ln(1 + market_forward_excess_returns)) - 1 AS y_arith FROM panel",
          KEY + [("y_log", 10), ("y_arith", 10)])
def b10_target_log(spark, sf_dir):
    """log1p target and its expm1 inverse."""
    from panelkit.functions.compat import expm1
    p = FE.target_log(T.panel(spark, sf_dir), out="y_log")
    return p.select("series_id", "t", "y_log", expm1("y_log").alias("y_arith"))


# ----------------------------------------------------------------- P3 / P4 / P5

_GAP_FEATS = ["P1", "E1", "V1", "M1", "D1"]


@register("p3_impute_flags",
          ctes.PANEL + ctes.GAPS + """
SELECT series_id, t, coalesce(P1, -9999.0) AS P1, coalesce(E1, -9999.0) AS E1, coalesce(V1, -9999.0) AS V1,
       coalesce(M1, -9999.0) AS M1, coalesce(D1, -9999.0) AS D1,
       CAST(P1 IS NULL AS INTEGER) AS P1_is_missing, CAST(E1 IS NULL AS INTEGER) AS E1_is_missing,
       CAST(M1 IS NULL AS INTEGER) AS M1_is_missing
FROM panel_gaps""",
          KEY + [(c, 6) for c in _GAP_FEATS] + [(f"{c}_is_missing", "i") for c in ("P1", "E1", "M1")])
def p3_impute_flags(spark, sf_dir):
    """Missing flags only for columns that hold a NULL, then sentinel fill."""
    g = T.panel_gaps(spark, sf_dir).select("series_id", "t", *_GAP_FEATS)
    out, flags = FE.impute(g)
    return out.select("series_id", "t", *_GAP_FEATS, *flags)


# px / qty plus log-price and root-volume; the 2-decimal disc / tax columns give
# exact decimal ties in window means that the two engines' summation orders
# round differently, so they are not used for the oracle comparison
_LONG_FEATS = ["px", "qty", "lpx", "rqty"]


def _p4_sql() -> str:
    part = "series_id, feature"
    cols = []
    for k in FE.WINDOWS:
        cols += [f"{G.roll('avg', 'u', k, 5, part)} AS mean_{k}",
                 f"{G.roll('stddev_samp', 'u', k, 5, part)} AS std_{k}",
                 f"{G.sdiv('u', G.lag('u', k, part))} - 1 AS roc_{k}",
                 f"{G.roll('sum', 'u', k, 5, part)} AS cum_{k}"]
    cols += ["u AS lag_1"] + [f"{G.lag('u', j - 1, part)} AS lag_{j}" for j in FE.LAGS[1:]]
    names = FE.extension_names()
    filled = ", ".join(f"coalesce({G.fin(n)}, -9999.0) AS {n}" for n in names)
    return (ctes.PANEL + """,
base4 AS (SELECT series_id, t, px, qty, ln(px) AS lpx, sqrt(qty) AS rqty FROM panel),
lng AS (SELECT * FROM base4 UNPIVOT INCLUDE NULLS (value FOR feature IN (px, qty, lpx, rqty))),
lu AS (SELECT *, lag(value, 1) OVER (PARTITION BY series_id, feature ORDER BY t) AS u FROM lng)"""
            + G.ewm_ctes("lu", "u", {"ema_fast": A_FAST, "ema_slow": A_SLOW}, part=("series_id", "feature"))
            + f""",
f AS (SELECT *, {', '.join(cols)} FROM ewm),
g AS (SELECT *, ema_fast - ema_slow AS ema_diff, {G.sdiv('ema_fast', 'ema_slow')} - 1 AS ema_ratio FROM f),
p4 AS (SELECT series_id, t, feature, {filled} FROM g)""")


@register("p4_extend_long",
          G.recursive(_p4_sql() + "\nSELECT * FROM p4"),
          KEY + [("feature", "s")] + [(n, _digits(n)) for n in FE.extension_names()])
def p4_extend_long(spark, sf_dir):
    """36 rolling / roc / lag / EWM statistics per (series, t, feature), long layout."""
    p = T.panel(spark, sf_dir).withColumns({"lpx": F.ln("px"), "rqty": F.sqrt("qty")})
    lng = FE.to_long(p, _LONG_FEATS)
    return FE.extend_long(lng).select("series_id", "t", "feature", *FE.extension_names())


@register("p5_guard_stats",
          ctes.PANEL + ctes.GAPS + """,
base5 AS (SELECT series_id, t, P1, E1, V1, M1, D1 FROM panel_gaps),
lng AS (SELECT * FROM base5 UNPIVOT INCLUDE NULLS (value FOR feature IN (P1, E1, V1, M1, D1)))
SELECT feature, min(coalesce(value, -9999.0)) AS vmin, max(coalesce(value, -9999.0)) AS vmax,
       var_pop(coalesce(value, -9999.0)) AS var_pop,
       min(coalesce(value, -9999.0)) <> max(coalesce(value, -9999.0))
         AND var_pop(coalesce(value, -9999.0)) > 1e-10 AS keep
FROM lng GROUP BY feature""",
          [("feature", "s"), ("vmin", 6), ("vmax", 6), ("var_pop", 2), ("keep", "b")])
def p5_guard_stats(spark, sf_dir):
    """Guard decision per feature: constant / near-constant features are dropped."""
    g = T.panel_gaps(spark, sf_dir)
    st = FE.guard_stats(FE.to_long(g, _GAP_FEATS))
    return st.withColumn("keep", (F.col("vmin") != F.col("vmax")) & (F.col("var_pop") > FE.VARIANCE_FLOOR))


_KEPT_SQL = " UNION ALL ".join(
    f"SELECT series_id, t, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), -9999.0) AS value FROM filled "
    f"WHERE (SELECT min(coalesce({c}, -9999.0)) <> max(coalesce({c}, -9999.0)) "
    f"AND var_pop(coalesce({c}, -9999.0)) > 1e-10 FROM filled)" for c in _GAP_FEATS)


@register("p5_guard_long",
          ctes.PANEL + ctes.GAPS + ", filled AS MATERIALIZED (SELECT * FROM panel_gaps) " + _KEPT_SQL,
          KEY + [("feature", "s"), ("value", 6)])
def p5_guard_long(spark, sf_dir):
    """Guarded long panel: kept features only (semi join), non-finite -> sentinel."""
    g = T.panel_gaps(spark, sf_dir)
    return FE.guard_long(FE.to_long(g, _GAP_FEATS))


@register("p5_guard_wide",
          ctes.PANEL + ctes.GAPS + """
SELECT series_id, t, forward_returns, risk_free_rate, market_forward_excess_returns,
       coalesce(P1, -9999.0) AS P1, coalesce(E1, -9999.0) AS E1, coalesce(V1, -9999.0) AS V1,
       coalesce(M1, -9999.0) AS M1
FROM panel_gaps""",
          KEY + [("forward_returns", 8), ("risk_free_rate", 8), ("market_forward_excess_returns", 8),
                 ("P1", 6), ("E1", 6), ("V1", 6), ("M1", 6)])
def p5_guard_wide(spark, sf_dir):
    """Wide guard: excluded columns first, constant D1 dropped."""
    g = T.panel_gaps(spark, sf_dir).drop("rn")
    return FE.guard_wide(g)


# ----------------------------------------------------------------- P6-P9

_EX_SQL_SRC = """,
wide AS (SELECT series_id, t, market_forward_excess_returns AS target,
                CASE WHEN (rn + series_id) % 11 = 0 THEN NULL ELSE qty END AS I2,
                disc AS I1, tax AS I9, px / 1000 AS I7, px AS M11,
                CASE WHEN (rn + series_id) % 13 = 0 THEN NULL ELSE disc END AS S2,
                CASE WHEN rn <= 3 THEN NULL ELSE tax END AS E2,
                qty AS E3, px AS P9, disc AS S1, tax AS S5, qty AS P8, px AS P10, disc AS P12, tax AS P13
         FROM numbered)"""


def _example_src(spark, sf_dir, series=None):
    w = R.series_window()
    p = T.panel(spark, sf_dir, series).withColumn("rn", F.row_number().over(w))
    rn, sid = F.col("rn"), F.col("series_id")
    return p.select(
        "series_id", "t", F.col("market_forward_excess_returns").alias("target"),
        F.when((rn + sid) % 11 == 0, None).otherwise(F.col("qty")).alias("I2"),
        F.col("disc").alias("I1"), F.col("tax").alias("I9"), (F.col("px") / 1000).alias("I7"),
        F.col("px").alias("M11"),
        F.when((rn + sid) % 13 == 0, None).otherwise(F.col("disc")).alias("S2"),
        F.when(rn <= 3, None).otherwise(F.col("tax")).alias("E2"),
        F.col("qty").alias("E3"), F.col("px").alias("P9"), F.col("disc").alias("S1"),
        F.col("tax").alias("S5"), F.col("qty").alias("P8"), F.col("px").alias("P10"),
        F.col("disc").alias("P12"), F.col("tax").alias("P13"))


def _p6_sql() -> str:
    keep = list(FE.EXAMPLE_KEEP)
    sql = ctes.PANEL + ",\nnumbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS rn FROM panel)"
    sql += _EX_SQL_SRC + f""",
ex0 AS (SELECT series_id, t, target, {', '.join(c for c in keep if c not in ('U1', 'U2'))},
               I2 - I1 AS U1, {G.sdiv('M11', '(I2 + I9 + I7) / 3')} AS U2 FROM wide)"""
    prev = "ex0"
    for c in keep:
        sql += G.ewm_ctes(prev, c, {f"e_{c}": A_COM}, adjust=True, name=f"x_{c}")
        prev = f"x_{c}"
    sel = ", ".join(f"coalesce({c}, e_{c}) AS {c}" for c in keep)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in keep)
    return sql + f"\nSELECT * FROM (SELECT series_id, t, target, {sel} FROM {prev}) z WHERE target IS NOT NULL AND {nn}"


@register("p6_example_dataset", G.recursive(_p6_sql()),
          KEY + [("target", 8)] + [(c, 4) for c in FE.EXAMPLE_KEEP])
def p6_example_dataset(spark, sf_dir):
    """Derived U1/U2, 13 kept features, EWM(com 0.5) NULL fill, drop remaining NULL rows."""
    return FE.example_dataset(_example_src(spark, sf_dir))


@register("p7_business_calendar",
          ctes.PANEL + """,
n AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS rn FROM panel)
SELECT series_id, t, rn,
       CAST(DATE '1990-01-01' + CAST(floor(rn / 5) * 7 + rn % 5 AS INTEGER) AS DATE) AS date
FROM n""", KEY + [("rn", "i"), ("date", "date")])
def p7_business_calendar(spark, sf_dir):
    """Synthetic business-day date from the row position (D1; 1990-01-01 is a Monday)."""
    p = T.panel(spark, sf_dir)
    p = p.withColumn("rn", R.row_index(R.series_window()))
    return FE.add_date(p).select("series_id", "t", "rn", "date")


@register("p8_first_complete",
          ctes.PANEL + ctes.GAPS + """,
st AS (SELECT series_id, greatest(min(CASE WHEN P1 IS NOT NULL THEN t END),
                                  min(CASE WHEN E1 IS NOT NULL THEN t END),
                                  min(CASE WHEN V1 IS NOT NULL THEN t END)) AS start
       FROM panel_gaps GROUP BY series_id)
SELECT g.series_id, g.t, g.P1, g.E1, g.V1 FROM panel_gaps g JOIN st ON g.series_id = st.series_id
WHERE g.t >= st.start""", KEY + [("P1", 6), ("E1", 6), ("V1", 6)])
def p8_first_complete(spark, sf_dir):
    """Keep rows from the first date on which every feature has started."""
    g = T.panel_gaps(spark, sf_dir)
    return FE.first_complete(g, ["P1", "E1", "V1"]).select("series_id", "t", "P1", "E1", "V1")


@register("p9_expanding_mean_fill",
          ctes.PANEL + ctes.GAPS + f"""
SELECT series_id, t,
       coalesce(E1, avg(E1) OVER (PARTITION BY series_id ORDER BY t
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS E1,
       coalesce(P1, avg(P1) OVER (PARTITION BY series_id ORDER BY t
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS P1
FROM panel_gaps""", KEY + [("E1", 6), ("P1", 6)])
def p9_expanding_mean_fill(spark, sf_dir):
    """NULL -> mean of the earlier rows of the series (no look-ahead)."""
    g = T.panel_gaps(spark, sf_dir)
    return FE.impute_expanding_mean(g, ["E1", "P1"]).select("series_id", "t", "E1", "P1")


@register("p9_median_fill",
          ctes.PANEL + ctes.GAPS + """
SELECT g.series_id, g.t, coalesce(g.E1, m.me) AS E1, coalesce(g.P1, m.mp) AS P1
FROM panel_gaps g JOIN (SELECT series_id, median(E1) AS me, median(P1) AS mp FROM panel_gaps
                        GROUP BY series_id) m ON g.series_id = m.series_id""",
          KEY + [("E1", 6), ("P1", 6)])
def p9_median_fill(spark, sf_dir):
    """Research mode of P9: NULL -> the series' median (looks ahead)."""
    g = T.panel_gaps(spark, sf_dir)
    return FE.impute_global_median(g, ["E1", "P1"]).select("series_id", "t", "E1", "P1")


# ----------------------------------------------------------------- end to end

_PIPE_OUT = ["MOM_mean_5", "MOM_std_252", "MOM_ema_fast", "MOM_lag_126", "VI_regime_highvol", "VI_regime_shock", "VI_volofvol_21",
             "px_mean_5", "px_std_21", "px_lag_1", "px_ema_fast"]


def _pipeline_sql() -> str:
    body = _p2_sql(-9999.0).rsplit("\nSELECT series_id, t, VI_regime_highvol", 1)[0]
    filled = ", ".join(f"coalesce({G.fin(c)}, -9999.0) AS {c}" for c in _PIPE_OUT[-4:])
    return (body + """,
pu AS (SELECT series_id, t, px, qty, lag(px, 1) OVER (PARTITION BY series_id ORDER BY t) AS u,
              row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS rn FROM panel)"""
            + G.ewm_ctes("pu", "u", {"px_ema_fast": A_FAST}, name="xpx") + f""",
px4 AS (SELECT *, {G.roll('avg', 'u', 5, 5)} AS px_mean_5, {G.roll('stddev_samp', 'u', 21, 5)} AS px_std_21, u AS px_lag_1 FROM xpx),
pxf AS (SELECT series_id, t, px, qty, rn, {filled} FROM px4)
SELECT p2b.series_id, p2b.t, CAST(DATE '1990-01-01' + CAST(floor(rn / 5) * 7 + rn % 5 AS INTEGER) AS DATE) AS date,
       y AS log_market_forward_excess_returns, px, qty, {', '.join(_PIPE_OUT)}
FROM p2b JOIN pxf ON p2b.series_id = pxf.series_id AND p2b.t = pxf.t""")


@register("panel_pipeline", G.recursive(_pipeline_sql()),
          KEY + [("date", "date"), ("log_market_forward_excess_returns", 8), ("px", 6), ("qty", 6)]
          + [(c, "i" if "regime" in c else 3 if "volofvol" in c else 6) for c in _PIPE_OUT])
def panel_pipeline(spark, sf_dir):
    """Calendar, log target, momentum, volatility, fills, extension and guards of the raw panel in one run."""
    from panelkit.plans import pipeline as PL
    return PL.panel_pipeline(T.panel(spark, sf_dir), extend=["px"], stats=["mean_5", "std_21", "lag_1", "ema_fast"], together=True)
