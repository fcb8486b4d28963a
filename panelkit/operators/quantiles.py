"""Exact grouped quantiles without holding a group in a task.

1. One aggregate per group gives the row count and approximate quantiles a little
   below and above every requested one (rank error at most ``1 / ACCURACY``).  The
   margin is chosen by the group's size, so that the exact positions lie between.
2. Rows below a bracket are only counted, rows above it are dropped, rows inside it are
   counted by value; partial aggregation does that before the exchange.  What
   crosses it per group and quantile is one row per task and the bracket's
   distinct values, a share of the group that the margin bounds.  The brackets of up to
   ``FEW_GROUPS`` groups are broadcast, so that large groups are not brought together.
3. A running count over those values names both neighbours of every position at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.rolling import Keys, _keys, attach
from panelkit.plans.scan import one_key
from panelkit.plans.written import written

ACCURACY = 10_000
MARGINS = (0.001, 0.01, 0.1, 1.0)  # the first one that spans two rows and the rank error is used


FEW_GROUPS = 10_000


def few(stats: DataFrame, label: str) -> DataFrame:
    """Statistics by group, written once; marked for a broadcast if there are few groups, whose rows would else all meet in
    as few tasks as there are groups."""
    out = written(stats, label)
    return F.broadcast(out) if out.count() <= FEW_GROUPS else out


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Keys = ()) -> DataFrame:
    """``(by, q, quantile)``: linear-interpolated quantiles as pandas and ``quantile_cont`` give
    them.  NULL and NaN values do not count; NULL keys form one group; groups without values have no rows."""
    ks, qs = _keys(by), [float(q) for q in qs]
    x = df.select(one_key(ks).alias("pk_key"), F.col(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v"))
    probs = sorted({min(1.0, max(0.0, q + s * m)) for q in qs for m in MARGINS for s in (-1, 1)})
    at = {p: i for i, p in enumerate(probs)}
    edge = lambda p: F.col("e")[at[min(1.0, max(0.0, p))]]
    margin = len(MARGINS) - 1

    def pick(q: float, sign: int) -> Column:
        out = edge(q + sign * MARGINS[margin])
        for m in reversed(MARGINS[:margin]):
            out = F.when(F.col("n") * (m - 2.0 / ACCURACY) >= 2, edge(q + sign * m)).otherwise(out)
        return out

    brackets = x.groupBy("pk_key").agg(F.percentile_approx("v", probs, ACCURACY).alias("e"), F.count(F.lit(1)).alias("n"))
    brackets = brackets.select("pk_key", "n", F.array(*[F.struct(
        F.lit(q).alias("q"), pick(q, -1).alias("lo"), pick(q, 1).alias("hi")) for q in qs]).alias("b"))
    brackets = few(brackets, "brackets") if ks else brackets
    rows = x.join(brackets, "pk_key") if ks else attach(x.select("v"), brackets, ())
    key = F.struct("pk_key", "n").alias("pk_key")
    rows = rows.select(key, "v", F.explode("b").alias("b")).where(F.col("v") <= F.col("b.hi"))
    inside = F.when(F.col("v") >= F.col("b.lo"), F.col("v"))
    found = rows.groupBy("pk_key", F.col("b.q").alias("q"), inside.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("pk_key", "q").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("last", F.sum("c").over(order) - 1)
    h = F.col("q") * (F.col("pk_key.n") - 1)
    holds = lambda p: (F.col("last") - F.col("c") < p) & (p <= F.col("last"))
    out = found.groupBy("pk_key", "q").agg(F.max(F.when(holds(F.floor(h)), F.col("v"))).alias("a"),
                                           F.max(F.when(holds(F.ceil(h)), F.col("v"))).alias("z"))
    part = h - F.floor(h)
    return out.select(*[F.col("pk_key.pk_key")[k].alias(k) for k in ks], "q",
                      F.when(part == 0, F.col("a")).otherwise(F.col("a") + part * (F.col("z") - F.col("a"))).alias("quantile"))


def quantile_columns(qdf: DataFrame, by: Keys, qs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Pivot the long quantile table to one column per requested q."""
    ks = _keys(by)
    aggs = [F.max(F.when(F.col("q") == F.lit(float(q)), F.col("quantile"))).alias(n)
            for q, n in zip(qs, names)]
    return qdf.groupBy(*ks).agg(*aggs) if ks else qdf.agg(*aggs)


def median(df: DataFrame, value: str, by: Keys = (), out: str = "median") -> DataFrame:
    """``(by, out)``: the exact median of each group that has one."""
    ks = _keys(by)
    return exact_quantiles(df, value, [0.5], ks).select(*ks, F.col("quantile").alias(out))
