"""Registered queries: Structured Streaming.

Each query replays ``events`` through a file stream (``maxFilesPerTrigger=1``,
``Trigger.AvailableNow``) into a sink under the session's checkpoint folder, then
returns the sink as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.catalog import ctes
from panelkit.catalog import sqlgen as G
from panelkit.catalog.spec import register
from panelkit.catalog.q_features import _p1_sql
from panelkit.operators import features as FE
from panelkit.plans.scorer import LinearScorer
from panelkit.sources import tables as T
from panelkit.streaming import stream as ST


def _source(spark, sf_dir, step=None, close=None):
    root = ST.scratch(spark, "events-by-step")
    ST.write_steps(T.table(spark, sf_dir, "events"), root, step, close)
    return ST.read_stream(spark, root)


@register("t4_stream_features", G.recursive(_p1_sql(ctes.EVENTS + """,
tl AS (SELECT series_id, t, n, px, 0 AS forward_returns, 0 AS risk_free_rate, px AS y FROM hourly)""") + f"""
SELECT p1.series_id, CAST(p1.t AS VARCHAR) AS t, hourly.px, hourly.n, {', '.join(f'p1.{c}' for c in FE.momentum_names())}
FROM p1 JOIN hourly ON p1.series_id = hourly.series_id AND p1.t = hourly.t"""),
          [("series_id", "s"), ("t", "s"), ("px", 8), ("n", "i"), *((c, 6) for c in FE.momentum_names())])
def t4_stream_features(spark, sf_dir):
    """Hourly bars with the momentum columns (P1) kept in per-series state; files end at half past eleven at night,
    so hours are split over micro-batches.  Equal to the batch computation over the whole history."""
    src = _source(spark, sf_dir, F.to_date(F.col("ts") + F.expr("interval 30 minutes")), "3650 days")
    out, ck = ST.scratch(spark, "t4-out"), ST.scratch(spark, "t4-ckpt")
    ST.run_available_now(ST.stateful_features(src), out, ck)
    return spark.read.parquet(out).withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm:ss"))


@register("t5_stream_running_score", """
SELECT event_type, sum(ln(1 + value / 100.0)) AS log_growth, sum(value / 100.0) AS s,
       sum((value / 100.0) * (value / 100.0)) AS ss, count(*) AS n, max(value / 100.0) AS max_r
FROM events GROUP BY event_type""",
          [("event_type", "s"), ("log_growth", 6), ("s", 6), ("ss", 6), ("n", "i"), ("max_r", 6)])
def t5_stream_running_score(spark, sf_dir):
    """Running (update-mode) aggregates per key; the final state equals the batch aggregate."""
    src = _source(spark, sf_dir)
    out = ST.scratch(spark, "t5-out")

    def keep(batch, epoch):
        # update mode: each batch holds the newest running values of the keys it touched;
        # overwrite by batch id keeps a retried batch idempotent
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={epoch}")
    ST.run_available_now(ST.running_score(src), None, ST.scratch(spark, "t5-ckpt"), mode="update", foreach=keep)
    u = spark.read.parquet(out)
    cols = ["log_growth", "s", "ss", "n", "max_r"]
    last = u.groupBy("event_type").agg(F.max_by(F.struct(*cols), "batch_id").alias("v"))
    return last.select("event_type", *[F.col(f"v.{c}").alias(c) for c in cols])


@register("t6_watermark_hourly", ctes.EVENTS + """
SELECT series_id, CAST(t AS VARCHAR) AS t, px, n FROM hourly""", [("series_id", "s"), ("t", "s"), ("px", 8), ("n", "i")])
def t6_watermark_hourly(spark, sf_dir):
    """Hourly bars under a 1-hour watermark where some rows arrive a day late: the bars written on
    time and the late rows of the side table make every hour whole."""
    late = F.when(F.col("event_id") % 37 == 5, 1).otherwise(0)  # when a row arrives; none is left out
    src = lambda root: ST.read_stream(spark, root)
    root = ST.scratch(spark, "events-by-step")
    ST.write_steps(T.table(spark, sf_dir, "events"), root, F.date_add(F.to_date("ts"), late))
    out, dead = ST.scratch(spark, "t6-out"), ST.scratch(spark, "t6-late")
    ST.run_available_now(ST.hourly_with_watermark(src(root)), out, ST.scratch(spark, "t6-ckpt"))
    ST.late_rows(src(root), dead, ST.scratch(spark, "t6-late-ckpt"))
    bars = ST.complete_hours(spark.read.parquet(out), spark.read.parquet(f"{dead}/late"))
    return bars.withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm:ss"))


# features of the scored stream: the hour of the day, and the user's number, missing for some events
_T2_SQL = """
WITH x AS (SELECT event_id, ts, value AS y, CAST(extract(hour FROM ts) AS DOUBLE) AS a,
                  CASE WHEN event_id % 50 <> 7 THEN user_id / 1000.0::DOUBLE END AS b FROM events),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(y) AS my,
             covar_pop(a, y) AS cay, covar_pop(b, y) AS cby, covar_pop(a, b) AS cab FROM x WHERE b IS NOT NULL),
w AS (SELECT *, (cay * sb * sb - cab * cby) / (sa * sa * sb * sb - cab * cab) AS wa,
             (cby * sa * sa - cab * cay) / (sa * sa * sb * sb - cab * cab) AS wb FROM m)
SELECT event_id, CASE WHEN b IS NOT NULL THEN least(greatest(0.01 * (my + wa * (a - ma) + wb * (b - mb)) + 1, 0), 2) END AS prediction,
       CASE WHEN b IS NULL THEN 'missing_features' ELSE 'ok' END AS status FROM x, w"""


def _features(events):
    return events.withColumns({"a": F.hour("ts").cast("double"), "y": F.col("value"),
                               "b": F.when(F.col("event_id") % 50 != 7, F.col("user_id") / 1000.0)})


def _scored(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events")
    scorer = LinearScorer.fit(_features(ev.withColumn("ts", F.col("ts").cast("timestamp"))), ["a", "b"], "y", multiplier=0.01)
    out = ST.scratch(spark, "t2-out")
    ST.score_stream(_source(spark, sf_dir), out, lambda b: scorer(_features(b)), ST.scratch(spark, "t2-ckpt"), ["event_id"])
    return out


@register("t2_scored_stream", _T2_SQL, [("event_id", "i"), ("prediction", 6), ("status", "s")])
def t2_scored_stream(spark, sf_dir):
    """Every event scored in its micro-batch by a model fitted before (scaler, linear model, signal); rows
    with a missing feature are flagged, not dropped."""
    out = _scored(spark, sf_dir)
    rows = spark.read.parquet(f"{out}/pred").unionByName(spark.read.parquet(f"{out}/flagged"))
    return rows.select("event_id", "prediction", "status")


@register("t2_t3_stream_scoring", """
SELECT row_number() OVER (ORDER BY d) - 1 AS batch_id, n AS received, n AS expected, 0 AS missing, 0 AS unexpected, 0 AS repeated,
       0 AS bad_values, 'ok' AS status
FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_id % 50 <> 7 GROUP BY 1) x""",
          [("batch_id", "i"), ("received", "i"), ("expected", "i"), ("missing", "i"), ("unexpected", "i"), ("repeated", "i"),
           ("bad_values", "i"), ("status", "s")])
def t2_t3_stream_scoring(spark, sf_dir):
    """The status row of every scored micro-batch, one per day."""
    return spark.read.parquet(f"{_scored(spark, sf_dir)}/status")
