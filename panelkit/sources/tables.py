"""Parquet table access and the test panels derived from ``/root/testdata``.

Panels (FIXTURES.md part B) are built with the DataFrame API; the DuckDB twins
live in ``panelkit.catalog.ctes``.  The key of every panel is ``(series_id, t)``
and it is unique, so every window order is total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _daily(li: DataFrame, series: F.Column, by_series: bool = False) -> DataFrame:
    # partial aggregation happens map-side: the shuffle carries one row per
    # (series, day) and map task, never raw lineitem rows.  ``by_series`` is for many series with
    # hardly two rows a day, where that saves nothing: rows meet by series at once, which serves
    # the days and all windows over a series; the partitions are not merged by their size here, as
    # features in the long layout make many rows of one
    rows = li.select(series.alias("series_id"), F.to_date("l_shipdate").alias("t"),
                     "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    parts = int(li.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ((rows.repartition(parts, "series_id") if by_series else rows)
            .groupBy("series_id", "t")
            .agg(F.avg("l_extendedprice").alias("px"), F.sum("l_quantity").alias("qty"),
                 F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax")))


def _with_returns(base: DataFrame) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("t")
    px1 = F.lead("px").over(w)
    fr = F.lit(0.02) * (F.col("px1") - F.col("px")) / (F.col("px1") + F.col("px"))
    return (base.withColumn("px1", px1)
            .where(F.col("px1").isNotNull())
            .select("series_id", "t", "px", "qty", "disc", "tax",
                    fr.alias("forward_returns"),
                    (F.col("tax") / 252).alias("risk_free_rate"),
                    (fr - F.col("tax") / 252).alias("market_forward_excess_returns")))


def panel(spark: SparkSession, sf_dir: str, series: F.Column | None = None) -> DataFrame:
    """B1: one series per supplier (or per value of ``series``), daily, with forward returns in (-0.02, 0.02)."""
    li = table(spark, sf_dir, "lineitem")
    return _with_returns(_daily(li, F.col("l_suppkey") if series is None else series, by_series=series is None))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: one long series (series_id = 0)."""
    li = table(spark, sf_dir, "lineitem")
    return _with_returns(_daily(li, F.lit(0).cast("bigint")))


def panel_gaps(spark: SparkSession, sf_dir: str, series: F.Column | None = None) -> DataFrame:
    """Deterministic nulls: late start, scattered gaps, zeros, all-null, constant."""
    w = Window.partitionBy("series_id").orderBy("t")
    p = panel(spark, sf_dir, series).withColumn("rn", F.row_number().over(w))
    sid, rn = F.col("series_id"), F.col("rn")
    return p.select(
        "series_id", "t", "rn",
        F.when(rn <= 40 + 10 * (sid % 5), None).otherwise(F.col("px")).alias("P1"),
        F.when((rn + sid) % 17 == 0, None).otherwise(F.col("qty")).alias("E1"),
        F.col("disc").alias("V1"),
        F.when(sid % 10 == 3, None).otherwise(F.col("tax")).alias("M1"),
        F.lit(1.0).alias("D1"),
        "forward_returns", "risk_free_rate", "market_forward_excess_returns")


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second panel with few, long series: order priority x order date."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("series_id"),
                      F.to_date("o_orderdate").alias("t"))
            .agg(F.avg("o_totalprice").alias("px"), F.count(F.lit(1)).alias("n")))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 in batch form: hourly series per event type."""
    e = table(spark, sf_dir, "events")
    return (e.select(F.col("event_type").alias("series_id"),
                     F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("t"),
                     "value")
            .groupBy("series_id", "t")
            .agg(F.avg("value").alias("px"), F.count(F.lit(1)).alias("n")))


def scores(spark: SparkSession, sf_dir: str, series: F.Column | None = None) -> DataFrame:
    """A prediction per panel row from the mean of the 21 previous returns."""
    w = Window.partitionBy("series_id").orderBy("t").rowsBetween(-21, -1)
    p = panel(spark, sf_dir, series)
    pred = F.least(F.greatest(40 * F.coalesce(F.avg("forward_returns").over(w), F.lit(0.0)) + 1,
                              F.lit(0.0)), F.lit(2.0))
    return p.withColumn("prediction", pred)
