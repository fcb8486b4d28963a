"""Registered queries: columns, rows, ordering, joins, sources, scalar functions
(A2, A3, A6, B1-B9, C2, C3, C5, C6, E2-E5, U1-U9, D2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.catalog import ctes
from panelkit.catalog import sqlgen as G
from panelkit.catalog.spec import register
from panelkit.functions import compat as U
from panelkit.functions.calendar import years_between
from panelkit.operators import features as FE
from panelkit.operators import rolling as R
from panelkit.operators import order as OR
from panelkit.operators import score as S
from panelkit.sources import io as IO
from panelkit.sources import tables as T_

KEY = [("series_id", "i"), ("t", "date")]


@register("a2_lenient_cast", """
SELECT l_orderkey, l_linenumber, TRY_CAST(l_returnflag AS DOUBLE) AS l_returnflag,
       TRY_CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) AS l_quantity,
       TRY_CAST(CAST(l_linenumber AS VARCHAR) || 'x' AS DOUBLE) AS bad
FROM lineitem""", [("l_orderkey", "i"), ("l_linenumber", "i"), ("l_returnflag", 6), ("l_quantity", 6), ("bad", 6)])
def a2_lenient_cast(spark, sf_dir):
    """Cast all but the keys to double; unparsable strings become NULL instead of raising."""
    li = T_.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("string").alias("l_quantity"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("x")).alias("bad"))
    return IO.lenient_cast(li, keep=("l_orderkey", "l_linenumber"))


@register("a3_rename", ctes.PANEL + """
SELECT series_id, t, market_forward_excess_returns AS target, forward_returns AS lagged_forward_returns FROM panel""",
          KEY + [("target", 8), ("lagged_forward_returns", 8)])
def a3_rename(spark, sf_dir):
    p = T_.panel(spark, sf_dir).select("series_id", "t", "market_forward_excess_returns", "forward_returns")
    return IO.rename(p, {"market_forward_excess_returns": "target", "forward_returns": "lagged_forward_returns"})


@register("a6_collect_outputs", ctes.PANEL + ctes.SCORES + """
SELECT series_id, t, CAST(prediction AS DOUBLE) AS prediction FROM scores WHERE t < DATE '1998-01-01'
UNION ALL
SELECT series_id, t, CAST(1 AS DOUBLE) AS prediction FROM scores WHERE t >= DATE '1998-01-01'""",
          KEY + [("prediction", 8)])
def a6_collect_outputs(spark, sf_dir):
    """Stack batch outputs of different numeric types under one declared schema."""
    s = T_.scores(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("date")
    a = s.where(F.col("t") < cut).select("series_id", "t", "prediction")
    b = s.where(F.col("t") >= cut).select("series_id", "t", F.lit(1).alias("prediction"))
    schema = T.StructType([T.StructField("series_id", T.LongType()), T.StructField("t", T.DateType()),
                           T.StructField("prediction", T.DoubleType())])
    return IO.collect_outputs([a, b], schema)


@register("a5_run_result", ctes.PANEL + """,
x AS (SELECT series_id, CASE WHEN max(CASE WHEN series_id % 4 = 1 THEN 2.0 + 100 * forward_returns ELSE 1.0 END) > 2
                             THEN 'position_above_max' ELSE 'ok' END AS status FROM panel GROUP BY series_id)
SELECT count(*) FILTER (WHERE status <> 'ok') = 0 AS Succeeded,
       CASE WHEN count(*) FILTER (WHERE status <> 'ok') = 0 THEN 0 ELSE 1 END AS ErrorType,
       CASE WHEN count(*) FILTER (WHERE status <> 'ok') = 0 THEN NULL ELSE 'InvalidSubmission' END AS ErrorName,
       substr(string_agg(DISTINCT CASE WHEN status <> 'ok' THEN status END, '; '
                         ORDER BY CASE WHEN status <> 'ok' THEN status END), 1, 8000) AS ErrorDetails
FROM x""", [("Succeeded", "b"), ("ErrorType", "i"), ("ErrorName", "s"), ("ErrorDetails", "s")])
def a5_run_result(spark, sf_dir):
    """Run-result record from per-series score status codes."""
    p = T_.panel(spark, sf_dir)
    pos = F.when(F.col("series_id") % 4 == 1, 2.0 + 100 * F.col("forward_returns")).otherwise(1.0)
    st = S.adjusted_sharpe(p.withColumn("position", pos), by="series_id").select("series_id", "status")
    return IO.run_result(st)


@register("b1_b2_select_drop", ctes.PANEL + """
SELECT series_id, t, px, qty FROM panel""", KEY + [("px", 6), ("qty", 6)])
def b1_b2_select_drop(spark, sf_dir):
    p = T_.panel(spark, sf_dir)
    return p.drop("disc", "tax", "risk_free_rate").select("series_id", "t", "px", "qty")


@register("b3_derived_features", ctes.PANEL + f"""
SELECT series_id, t, qty - disc AS U1, {G.sdiv('px', '(qty + tax + disc) / 3')} AS U2 FROM panel""",
          KEY + [("U1", 6), ("U2", 6)])
def b3_derived_features(spark, sf_dir):
    """U1 = I2 - I1 and U2 = M11 / mean(I2, I9, I7) with I2=qty, I1=disc, I9=tax, I7=disc, M11=px."""
    p = T_.panel(spark, sf_dir)
    return p.select("series_id", "t", (F.col("qty") - F.col("disc")).alias("U1"),
                    U.safe_div("px", (F.col("qty") + F.col("tax") + F.col("disc")) / 3).alias("U2"))


@register("b4_numeric_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""",
          [("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"), ("l_quantity", 6),
           ("l_extendedprice", 6), ("l_discount", 6), ("l_tax", 6)])
def b4_numeric_columns(spark, sf_dir):
    """Select numeric columns by a schema walk (bool / date / string excluded)."""
    li = T_.table(spark, sf_dir, "lineitem")
    num = [f.name for f in li.schema.fields if isinstance(f.dataType, T.NumericType)]
    return li.select(*num)


@register("b5_category_groups", ctes.PANEL + ctes.GAPS + """,
gw AS (SELECT series_id, t, P1, E1, V1, M1, D1 FROM panel_gaps),
lng AS (SELECT * FROM gw UNPIVOT INCLUDE NULLS (value FOR feature IN (P1, E1, V1, M1, D1))),
f AS (SELECT DISTINCT feature FROM lng)
SELECT substr(feature, 1, 1) AS "group", string_agg(feature, ',' ORDER BY feature) AS features
FROM f GROUP BY substr(feature, 1, 1)""", [("group", "s"), ("features", "s")])
def b5_category_groups(spark, sf_dir):
    """First-letter feature groups from the long layout."""
    lng = FE.to_long(T_.panel_gaps(spark, sf_dir), ["P1", "E1", "V1", "M1", "D1"])
    c = FE.category_catalogue(lng)
    return c.select("group", F.array_join("features", ",").alias("features"))


@register("b7_e3_semi_join", ctes.PANEL + """
SELECT series_id, t, px FROM panel WHERE series_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 1)""",
          KEY + [("px", 6)])
def b7_e3_semi_join(spark, sf_dir):
    """Set-membership filter as a left semi join."""
    p = T_.panel(spark, sf_dir)
    s = T_.table(spark, sf_dir, "supplier").where(F.col("s_nationkey") == 1).select(
        F.col("s_suppkey").alias("series_id"))
    return p.join(s, "series_id", "left_semi").select("series_id", "t", "px")


@register("b8_dropna", ctes.PANEL + ctes.GAPS + """
SELECT series_id, t, P1, E1, M1 FROM panel_gaps WHERE P1 IS NOT NULL AND E1 IS NOT NULL AND M1 IS NOT NULL""",
          KEY + [("P1", 6), ("E1", 6), ("M1", 6)])
def b8_dropna(spark, sf_dir):
    return T_.panel_gaps(spark, sf_dir).select("series_id", "t", "P1", "E1", "M1").dropna("any")


@register("b9_drop_last_rows", ctes.PANEL + """
SELECT series_id, t, px FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS rd FROM panel) x
WHERE rd > 10""", KEY + [("px", 6)])
def b9_drop_last_rows(spark, sf_dir):
    """head(-10) per series."""
    p = T_.panel(spark, sf_dir)
    w = Window.partitionBy("series_id").orderBy(F.col("t").desc())
    return p.withColumn("_rd", F.row_number().over(w)).where(F.col("_rd") > 10).select("series_id", "t", "px")


@register("c2_head_tail", ctes.PANEL + """
SELECT series_id, t, px, 'head' AS part FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) AS r FROM panel) x WHERE r <= 3
UNION ALL
SELECT series_id, t, px, 'tail' AS part FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS r FROM panel) y WHERE r <= 3""",
          KEY + [("px", 6), ("part", "s")])
def c2_head_tail(spark, sf_dir):
    """First and last 3 rows of every series (positions from both ends on one sort, no global sort)."""
    p = T_.panel(spark, sf_dir)
    up = Window.partitionBy("series_id").orderBy("t")
    r, n = F.row_number().over(up), F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    p = p.select("series_id", "t", "px", r.alias("_r"), n.alias("_n"))
    part = F.array_compact(F.array(F.when(F.col("_r") <= 3, "head"), F.when(F.col("_r") > F.col("_n") - 3, "tail")))
    return p.where((F.col("_r") <= 3) | (F.col("_r") > F.col("_n") - 3)).select("series_id", "t", "px", F.explode(part).alias("part"))


@register("c3_top_bottom_k", ctes.PANEL + ctes.SCORES + """,
s AS (SELECT series_id, exp(avg(ln(1 + (risk_free_rate * (1 - prediction) + prediction * forward_returns - risk_free_rate)))) - 1 AS score
      FROM scores GROUP BY series_id)
SELECT * FROM (SELECT series_id, score, 'top' AS side FROM s ORDER BY score DESC, series_id LIMIT 5)
UNION ALL
SELECT * FROM (SELECT series_id, score, 'bottom' AS side FROM s ORDER BY score ASC, series_id LIMIT 5)""",
          [("series_id", "i"), ("score", 8), ("side", "s")])
def c3_top_bottom_k(spark, sf_dir):
    """Top-5 and bottom-5 series by geometric mean excess return, stacked (ordered limits)."""
    sc = T_.scores(spark, sf_dir)
    sr = S.strategy_return("prediction", "forward_returns", "risk_free_rate")
    s = sc.groupBy("series_id").agg(S.geo_mean(sr - F.col("risk_free_rate")).alias("score"))
    top = s.orderBy(F.col("score").desc(), "series_id").limit(5).withColumn("side", F.lit("top"))
    bot = s.orderBy(F.col("score").asc(), "series_id").limit(5).withColumn("side", F.lit("bottom"))
    return top.unionByName(bot)


@register("c5_sortedness_check", """
SELECT bool_and(coalesce(ts >= prev, true)) AS is_sorted, count(*) FILTER (WHERE ts < prev) AS violations
FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS prev FROM events) x""",
          [("is_sorted", "b"), ("violations", "i")])
def c5_sortedness_check(spark, sf_dir):
    """Is the time key sorted in arrival order (``event_id``)?  Per block, no global sort."""
    return OR.sortedness(T_.table(spark, sf_dir, "events"), "event_id", "ts")


@register("c6_ordered_distinct_keys", ctes.EVENTS + """
SELECT date_trunc('hour', ts) AS t, min(event_id) AS first_pos, count(*) AS n FROM events GROUP BY date_trunc('hour', ts)""",
          [("t", "s"), ("first_pos", "i"), ("n", "i")])
def c6_ordered_distinct_keys(spark, sf_dir):
    """Distinct batch keys with their first arrival position (maintain_order)."""
    e = T_.table(spark, sf_dir, "events")
    return (e.groupBy(F.date_trunc("hour", F.col("ts")).alias("t"))
            .agg(F.min("event_id").alias("first_pos"), F.count(F.lit(1)).alias("n"))
            .withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm:ss")))


@register("e2_join_dropna", ctes.PANEL + ctes.GAPS + """
SELECT series_id, t, P1, E1, forward_returns  -- (series, t) is unique, so the join of the panel with itself is the panel
FROM panel_gaps WHERE P1 IS NOT NULL AND E1 IS NOT NULL AND forward_returns IS NOT NULL""",
          KEY + [("P1", 6), ("E1", 6), ("forward_returns", 8)])
def e2_join_dropna(spark, sf_dir):
    """Inner equi-join on (series, t) followed by dropna."""
    p = T_.panel(spark, sf_dir).select("series_id", "t", "forward_returns")
    g = T_.panel_gaps(spark, sf_dir).select("series_id", "t", "P1", "E1")
    return p.join(g, ["series_id", "t"], "inner").dropna().select("series_id", "t", "P1", "E1", "forward_returns")


@register("e5_concat_common_columns", ctes.PANEL + ctes.GAPS + """
SELECT series_id, t, forward_returns, risk_free_rate FROM panel
UNION ALL
SELECT series_id, t, forward_returns, risk_free_rate FROM panel_gaps""",
          KEY + [("forward_returns", 8), ("risk_free_rate", 8)])
def e5_concat_common_columns(spark, sf_dir):
    """Vertical concat of two frames on their common columns (B6 + E5)."""
    a = T_.panel(spark, sf_dir)
    b = T_.panel_gaps(spark, sf_dir)
    common = [c for c in a.columns if c in b.columns]
    keep = [c for c in common if c in ("series_id", "t", "forward_returns", "risk_free_rate")]
    return a.select(*keep).unionByName(b.select(*keep))


@register("u_scalar_functions", ctes.PANEL + f"""
SELECT series_id, t,
       {G.log1p('market_forward_excess_returns')} AS lg,
       {G.clip('400 * market_forward_excess_returns + 1', 0, 2)} AS clipped,
       abs(forward_returns) AS a, sign(forward_returns) AS sg, sqrt(px) AS sq, power(qty, 2) AS pw,
       CASE WHEN forward_returns > 0 THEN 1.0 ELSE 0.0 END AS up,
       coalesce({G.sdiv('disc', 'tax')}, -9999.0) AS ratio_filled,
       CASE WHEN disc > 0.05 THEN 1 ELSE 0 END AS flag,
       greatest(forward_returns, 0) AS hinge, least(px, 50000) AS capped
FROM panel""", KEY + [("lg", 8), ("clipped", 6), ("a", 8), ("sg", 6), ("sq", 6), ("pw", 6), ("up", 6),
                      ("ratio_filled", 6), ("flag", "i"), ("hinge", 8), ("capped", 6)])
def u_scalar_functions(spark, sf_dir):
    """log1p, clip, abs, sign, sqrt, power, where, finite division + fill, flags, hinge and cap."""
    p = T_.panel(spark, sf_dir)
    fr = F.col("forward_returns")
    return p.select(
        "series_id", "t", U.log1p("market_forward_excess_returns").alias("lg"),
        U.clip(400 * F.col("market_forward_excess_returns") + 1, 0, 2).alias("clipped"),
        F.abs(fr).alias("a"), F.signum(fr).alias("sg"), F.sqrt("px").alias("sq"), F.pow("qty", 2).alias("pw"),
        F.when(fr > 0, 1.0).otherwise(0.0).alias("up"),
        U.sentinel(U.safe_div("disc", "tax"), FE.SENTINEL).alias("ratio_filled"),
        U.flag(F.col("disc") > 0.05).alias("flag"), U.hinge(fr).alias("hinge"), U.cap("px", 50000).alias("capped"))


@register("d2_years_between", ctes.PANEL + """
SELECT series_id, date_diff('day', min(t), max(t)) / 365.25 AS years FROM panel GROUP BY series_id""",
          [("series_id", "i"), ("years", 8)])
def d2_years_between(spark, sf_dir):
    p = T_.panel(spark, sf_dir)
    return p.groupBy("series_id").agg(years_between(F.min("t"), F.max("t")).alias("years"))


_CSV_SCHEMA = "series_id long, t date, px string, qty string, forward_returns string"


@register("a1_csv_scan", ctes.PANEL + """
SELECT series_id, t, px, qty, forward_returns FROM panel""",
          KEY + [("px", 6), ("qty", 6), ("forward_returns", 8)])
def a1_csv_scan(spark, sf_dir):
    """CSV with a header read back with an explicit schema, then the lenient numeric cast.

    The panel is written as CSV under the session's checkpoint folder first
    (17 significant digits, so doubles round-trip exactly)."""
    from panelkit.streaming.stream import scratch
    path = scratch(spark, "panel-csv")
    p = T_.panel(spark, sf_dir).select(
        "series_id", "t", *[F.format_string("%.17g", c).alias(c) for c in ("px", "qty", "forward_returns")])
    p.write.mode("overwrite").option("header", True).csv(path)
    return IO.lenient_cast(IO.read_csv(spark, path, _CSV_SCHEMA), keep=("series_id", "t"))


@register("a4_submission_sink", ctes.PANEL + ctes.SCORES + """
SELECT series_id, t, prediction FROM scores""", KEY + [("prediction", 8)])
def a4_submission_sink(spark, sf_dir):
    """Submission written with ids first (overwrite, idempotent on retry) and read back."""
    from panelkit.streaming.stream import scratch
    path = scratch(spark, "submission")
    s = T_.scores(spark, sf_dir).select("prediction", "t", "series_id")
    IO.write_submission(s, ["series_id", "t"], path)
    out = spark.read.parquet(path)
    assert out.columns[:2] == ["series_id", "t"]
    return out


@register("e4_aligned_columns", ctes.PANEL + f"""
SELECT series_id, t, forward_returns,
       {G.roll('stddev_samp', 'forward_returns', 21)} AS vol21,
       forward_returns / nullif({G.roll('stddev_samp', 'forward_returns', 21)}, 0) AS z
FROM panel""", KEY + [("forward_returns", 8), ("vol21", 6), ("z", 6)])
def e4_aligned_columns(spark, sf_dir):
    """Positional concat of derived columns as one projection on the same plan (no join)."""
    p = T_.panel(spark, sf_dir)
    w = R.series_window()
    d = p.select("series_id", "t", "forward_returns", R.roll_std("forward_returns", 21, w).alias("vol21"))
    return d.withColumn("z", U.safe_div("forward_returns", "vol21"))
