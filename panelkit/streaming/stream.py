"""Structured Streaming operators.

* T1 ordered micro-batches: one partitioned write, one file per step, read with
  ``maxFilesPerTrigger=1`` in the order of the steps, ``Trigger.AvailableNow``.
* T2/T3 scoring with a fitted scorer and validation per micro-batch; outputs are
  written with the batch id so a retried batch overwrites, not appends.
* T4 the momentum features (P1) per series in state: open hours, the last values
  and both EWMs.  An hour enters the features once the watermark has passed it, so
  hours split over files come out as in the batch.
* T5 running score: a streaming grouped aggregate in update mode.
* T6 hourly bars under a watermark, with every late row kept in a side table.

A replay ends with a marker, a row of a time far ahead without a key: it moves the
watermark past every open hour, so nothing stays open at the end.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from panelkit.functions import series
from panelkit.operators import features as FE
from panelkit.plans.scorer import Scorer
from panelkit.session import checkpoint_dir

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()), T.StructField("day", T.DateType())])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def write_steps(events: DataFrame, out: str, step: F.Column | None = None, close: str | None = "3650 days") -> str:
    """T1 fixture: ``events`` as one file per ``step`` (the day by default), written in one job.

    The file source reads files by modification time, so the files' times are set in the
    order of their steps.  With ``close`` two last files hold the end marker."""
    spark = events.sparkSession
    ev = events.withColumn("ts", F.col("ts").cast("timestamp"))
    ev = ev.withColumn("day", F.to_date("ts") if step is None else step)
    ev.repartition("day").write.mode("overwrite").partitionBy("day").parquet(out)
    if close:  # the batch after the first marker closes what the marker has passed
        last = ev.agg(F.max("ts").alias("ts"), F.max("day").alias("day")).where("ts is not null")
        marks = last.select((F.col("ts") + F.expr(f"interval {close}")).alias("ts"), F.explode(F.array(
            F.date_add("day", 1), F.date_add("day", 2))).alias("day"))
        marks = marks.select(*[F.col(c) if c in ("ts", "day") else F.lit(None).cast(ev.schema[c].dataType).alias(c) for c in ev.columns])
        marks.repartition("day").write.mode("append").partitionBy("day").parquet(out)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = sorted(str(d.getPath()) for d in fs.listStatus(path) if d.isDirectory())
    for i, d in enumerate(days):  # one entry per step
        for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(d)):
            fs.setTimes(f.getPath(), 1_600_000_000_000 + 1000 * i, -1)
    return out


def read_stream(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Ordered micro-batches, one file per trigger."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("basePath", path).parquet(path))


def run_available_now(df: DataFrame, sink: str, ckpt: str, mode: str = "append",
                      fmt: str = "parquet", foreach: Callable | None = None) -> None:
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    q = w.foreachBatch(foreach).start() if foreach is not None else w.format(fmt).start(sink)
    q.awaitTermination()


def _real() -> F.Column:
    """Not the end marker.  The condition names the time too, so that it is not moved below
    the watermark, which must see the marker."""
    return F.when(F.col("ts").isNotNull(), F.col("event_type")).isNotNull()


# ----------------------------------------------------------------- T4 state

_REACH = max(max(FE.WINDOWS), max(FE.LAGS)) + 2
FEATURE_OUT = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("t", T.TimestampType()),
    T.StructField("px", T.DoubleType()), T.StructField("n", T.LongType()),
    *(T.StructField(c, T.DoubleType()) for c in FE.momentum_names())])
FEATURE_STATE = T.StructType([
    T.StructField("hour", T.ArrayType(T.LongType())), T.StructField("total", T.ArrayType(T.DoubleType())),
    T.StructField("count", T.ArrayType(T.LongType())), T.StructField("pos", T.LongType()),
    T.StructField("tail", T.ArrayType(T.DoubleType())), T.StructField("ema", T.ArrayType(T.DoubleType()))])
_HOUR_MS = 3_600_000


def _momentum(old: np.ndarray, new: np.ndarray, pos: int, means: list) -> tuple[dict, list]:
    """The P1 columns of the bars ``new`` that follow ``old`` (``pos`` bars stand before them), and the EWM means after."""
    x = np.concatenate([old, new])
    u, home = series.shifted(x, 1), slice(len(old), None)
    out = {}
    for k in FE.WINDOWS:
        t = series.trailing(u, k)
        out.update({f"MOM_mean_{k}": t["mean"][home], f"MOM_std_{k}": t["std"][home], f"MOM_roc_{k}": series.rate(u, k)[home],
                    f"MOM_cum_{k}": t["sum"][home]})
    at, after = np.arange(pos, pos + len(new)), []
    for (name, span), mean in zip(FE.EMA_SPANS.items(), means):
        state = (None, None, 0.0) if mean is None else (pos - 1, mean, 1.0)
        out[f"MOM_{name}"], state = series.ewm(u[home], at, 2.0 / (span + 1.0), False, state)
        after.append(state[1])
    out.update({f"MOM_lag_{j}": series.shifted(x, j)[home] for j in FE.LAGS})
    fast, slow = out["MOM_ema_fast"], out["MOM_ema_slow"]
    with np.errstate(all="ignore"):
        out["MOM_ema_diff"], out["MOM_ema_ratio"] = fast - slow, fast / slow - 1
        out["MOM_std_21_252_ratio"] = out["MOM_std_21"] / out["MOM_std_252"]
    return {c: np.where(np.isfinite(out[c]), out[c], FE.SENTINEL) for c in FE.momentum_names()}, after


def _feature_step(key, pdfs, state):
    """Close the hours that the watermark has passed and emit their features."""
    hours, pos, tail, ema = {}, 0, [], [None] * len(FE.EMA_SPANS)
    if state.exists:
        h, total, count, pos, tail, ema = state.get
        hours = {a: [b, c] for a, b, c in zip(h, total, count)}
        ema = [None if m is None or np.isnan(m) else float(m) for m in ema]
    for pdf in pdfs:
        at = pdf["ts"].astype("int64") if str(pdf["ts"].dtype) == "int64" else pdf["ts"].astype("datetime64[ms]").astype("int64")
        for hour, v in pdf["value"].groupby(at // _HOUR_MS):
            had = hours.setdefault(int(hour), [0.0, 0])
            had[0], had[1] = had[0] + float(v.sum()), had[1] + int(v.count())
    mark = state.getCurrentWatermarkMs()
    done = sorted(h for h in hours if (h + 1) * _HOUR_MS <= mark)
    closed = [(h, *hours.pop(h)) for h in done]
    if closed:
        px = np.array([s / n if n else np.nan for _, s, n in closed])
        cols, ema = _momentum(np.array(tail, float), px, pos, ema)
        pos, tail = pos + len(px), [*tail, *px.tolist()][-_REACH:]
        yield pd.DataFrame({"series_id": key[0], "t": pd.to_datetime([h * _HOUR_MS for h in done], unit="ms"), "px": px,
                            "n": [n for _, _, n in closed], **cols})[[f.name for f in FEATURE_OUT.fields]]
    left = sorted(hours)
    state.update((left, [hours[h][0] for h in left], [hours[h][1] for h in left], pos, [float(v) for v in tail],
                  [float("nan") if m is None else float(m) for m in ema]))
    if left:
        state.setTimeoutTimestamp(max((left[0] + 1) * _HOUR_MS, mark + 1))


def stateful_features(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """T4: hourly bars of every series with the columns of P1 on their price, equal to the batch over the
    whole history for rows at most ``delay`` late."""
    ev = stream.withWatermark("ts", delay).where(_real())
    return ev.select(F.col("event_type").alias("series_id"), "ts", "value").groupBy("series_id").applyInPandasWithState(
        _feature_step, FEATURE_OUT, FEATURE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ----------------------------------------------------------------- T5 / T6

def running_score(stream: DataFrame, key: str = "event_type", value: str = "value",
                  scale: float = 100.0) -> DataFrame:
    """T5: running growth (sum of log1p), sum, sum of squares, count, max per key."""
    r = F.col(value) / scale
    return stream.groupBy(key).agg(
        F.sum(F.log1p(r)).alias("log_growth"), F.sum(r).alias("s"), F.sum(r * r).alias("ss"),
        F.count(F.lit(1)).alias("n"), F.max(r).alias("max_r"))


def hourly_with_watermark(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Event-time hourly bars, each written once the watermark has passed its end."""
    ev = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).where(_real())
    return (ev.groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
            .agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
            .select(F.col("event_type").alias("series_id"), F.col("w.start").alias("t"), "total", "n"))


def late_rows(stream: DataFrame, out: str, ckpt: str, delay: str = "1 hour") -> None:
    """The rows that ``hourly_with_watermark`` over the same files drops, by batch id.

    A batch drops what lies behind the watermark of the batch before it, which is the largest time
    of all batches before that one less ``delay``; those times are written per batch, so a retried
    batch sees the same ones."""
    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        top = batch.agg(F.max("ts").alias("top"), F.lit(epoch).alias("epoch"))
        top.write.mode("overwrite").parquet(f"{out}/times/batch_id={epoch}")
        seen = spark.read.schema("top timestamp, epoch int").parquet(f"{out}/times").where(F.col("epoch") < epoch - 1)
        mark = seen.agg((F.max("top") - F.expr(f"interval {delay}")).alias("mark"))
        end = F.date_trunc("hour", "ts") + F.expr("interval 1 hour")
        late = batch.where(F.col("event_type").isNotNull()).join(F.broadcast(mark), end <= F.col("mark"))  # one row
        late.drop("mark").write.mode("overwrite").parquet(f"{out}/late/batch_id={epoch}")
    run_available_now(stream, out, ckpt, foreach=each)


def complete_hours(bars: DataFrame, late: DataFrame) -> DataFrame:
    """Bars and late rows together: every hour as the batch computes it."""
    more = late.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("t")).agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    both = bars.select("series_id", "t", "total", "n").unionByName(more)
    both = both.groupBy("series_id", "t").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return both.select("series_id", "t", (F.col("total") / F.col("n")).alias("px"), "n")


# ----------------------------------------------------------------- T2 / T3

def validate_batches(pred: DataFrame, expected: DataFrame, ids: list[str], value: str = "prediction",
                     by: str = "batch_id") -> DataFrame:
    """One status row per batch from received and expected ids.

    ``received`` must equal ``expected`` id by id: missing, unexpected and
    repeated ids are counted, and so are values that are NULL, NaN or infinite.
    """
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    got = pred.groupBy(by, *ids).agg(F.count(F.lit(1)).alias("_r"), F.count_if(bad).alias("_b"))
    want = expected.select(by, *ids).distinct().withColumn("_e", F.lit(1))
    want = want.withColumnsRenamed({c: f"pk_{c}" for c in (by, *ids)})
    on = [F.col(c).eqNullSafe(F.col(f"pk_{c}")) for c in (by, *ids)]
    j = got.join(want, on, "full").withColumn(by, F.coalesce(by, f"pk_{by}"))
    r, e = F.coalesce("_r", F.lit(0)), F.coalesce("_e", F.lit(0))
    a = j.groupBy(by).agg(
        F.sum(r).alias("received"), F.sum(e).cast("long").alias("expected"),
        F.count_if((e > 0) & (r == 0)).alias("missing"), F.count_if(e == 0).alias("unexpected"),
        F.sum(F.greatest(r - 1, F.lit(0))).alias("repeated"), F.coalesce(F.sum("_b"), F.lit(0)).alias("bad_values"))
    status = (F.when(F.col("expected") == 0, "no_expected_rows").when(F.col("bad_values") > 0, "invalid_prediction")
              .when(F.col("repeated") > 0, "repeated_id")
              .when((F.col("missing") > 0) | (F.col("unexpected") > 0), "id_mismatch").otherwise("ok"))
    return a.withColumn("status", status)


def validate_batch(pred: DataFrame, expected_ids: DataFrame, ids: list[str], value: str = "prediction") -> DataFrame:
    """T3 for a single batch: one status row; an empty batch has the status ``no_expected_rows``."""
    one = F.lit(0).alias("batch_id")
    st = validate_batches(pred.select("*", one), expected_ids.select("*", one), ids, value)
    blank = st.sparkSession.range(1).select(F.col("id").cast("int").alias("batch_id"))
    out = blank.join(st, "batch_id", "left").drop("batch_id")
    counts = ["received", "expected", "missing", "unexpected", "repeated", "bad_values"]
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts}).withColumn(
        "status", F.coalesce("status", F.lit("no_expected_rows")))


def score_stream(stream: DataFrame, out: str, scorer: Scorer, ckpt: str, ids: list[str]) -> None:
    """T2 + T3: score each micro-batch, validate it, write a status row and the
    predictions keyed by the batch id (idempotent on retry).  Rows the scorer flags go to
    ``flagged``; of the others the predictions of a batch that fails go to ``quarantine`` instead of ``pred``."""
    def each(batch: DataFrame, epoch: int) -> None:
        scored = scorer(batch.where(F.col(ids[0]).isNotNull()))
        good = scored.where("status = 'ok'")
        scored.where("status <> 'ok'").write.mode("overwrite").parquet(f"{out}/flagged/batch_id={epoch}")
        where = f"{out}/status/batch_id={epoch}"
        validate_batch(good, good.select(*ids), ids).write.mode("overwrite").parquet(where)
        ok = batch.sparkSession.read.parquet(where).first().status == "ok"
        good.write.mode("overwrite").parquet(f"{out}/{'pred' if ok else 'quarantine'}/batch_id={epoch}")
    run_available_now(stream, out, ckpt, foreach=each)
