"""Validation splits (V1-V3, V5, V6) as small fold tables plus range joins.

A fold table has one row per (series, fold) with integer row-position bounds;
rows are matched to folds by an equi-join on the series keys and a range
filter on the row position (E6).  A row appears once per fold it belongs to,
which is the walk-forward data volume itself (at most ``n_splits`` copies).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.rolling import Keys, _keys, attach

EVAL_TAIL_MAX, EVAL_TAIL_MIN, EVAL_TAIL_SHARE = 252, 50, 5


def time_folds(counts: DataFrame, n_splits: int, test_size: int, gap: int = 0,
               keys: Keys = "series_id", n: str = "n") -> DataFrame:
    """Expanding-window time-series folds (V1-V3) from per-series row counts.

    Fold i (0-based): test = [n - (k-i)*size, +size); train = [0, test_lo - gap);
    eval tail = last max(min(len(train)//5, 252), 50) train rows; fit = the
    rest of train.  Series with n <= k*size get ``valid = false``.
    """
    ks = _keys(keys)
    f = counts.select(*ks, n, F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
    test_lo = F.col(n) - (F.lit(n_splits) - F.col("fold")) * test_size
    f = f.withColumn("test_lo", test_lo).withColumn("test_hi", test_lo + test_size)
    f = f.withColumn("train_hi", F.col("test_lo") - gap)
    tail = F.greatest(F.least(F.floor(F.col("train_hi") / EVAL_TAIL_SHARE), F.lit(EVAL_TAIL_MAX)),
                      F.lit(EVAL_TAIL_MIN))
    f = f.withColumn("fit_hi", F.col("train_hi") - tail)
    status = (F.when(F.col(n) <= n_splits * test_size, "too_short")
              .when(F.col("fit_hi") <= 0, "no_fit_rows").otherwise("ok"))
    return (f.withColumn("valid", F.col(n) > n_splits * test_size).withColumn("status", status)
            .withColumn("fold", F.col("fold") + 1))


def assign_roles(df: DataFrame, folds: DataFrame, keys: Keys = "series_id", rn: str = "rn") -> DataFrame:
    """Rows x folds with ``role`` in {fit, eval, test} (train = fit + eval)."""
    ks = _keys(keys)
    j = attach(df, folds.where("valid").drop("valid", "status"), ks)
    r = F.col(rn)
    role = (F.when((r >= F.col("test_lo")) & (r < F.col("test_hi")), "test")
            .when(r < F.col("fit_hi"), "fit")
            .when(r < F.col("train_hi"), "eval"))
    return j.withColumn("role", role).where(F.col("role").isNotNull())


def kfold_contiguous(df: DataFrame, k: int, keys: Keys = (), rn: str = "rn", n: str = "n") -> DataFrame:
    """KFold(k) without shuffling (V6): the first n % k folds get one extra row."""
    q = F.floor(F.col(n) / k)
    r = F.col(n) % k
    big = r * (q + 1)
    fold = F.when(F.col(rn) < big, F.floor(F.col(rn) / (q + 1))).otherwise(
        r + F.floor((F.col(rn) - big) / q))
    return df.withColumn("fold", fold.cast("int"))


def fold_dates(rows: DataFrame, folds: DataFrame, order: str = "t", keys: Keys = "series_id",
               rn: str = "rn") -> DataFrame:
    """Train/test start, end and size of every valid fold with train rows (V5) from its bounds: only the rows at
    a bound are read, no row is copied."""
    ks = _keys(keys)
    f = folds.where("valid and train_hi > 0")
    at = F.array(F.lit(0).cast("long"), F.col("train_hi") - 1, F.col("test_lo"), F.col("test_hi") - 1)
    bounds = f.groupBy(*ks).agg(F.array_distinct(F.flatten(F.collect_list(at))).alias("pk_bounds"))
    marks = attach(rows.select(*ks, rn, order), bounds, ks).where(F.array_contains("pk_bounds", F.col(rn)))
    marks = marks.groupBy(*ks).agg(F.map_from_entries(F.collect_list(F.struct(rn, order))).alias("pk_m"))
    t = lambda pos: F.col("pk_m")[pos]
    return attach(f, marks, ks).select(
        *ks, "fold", t(F.lit(0).cast("long")).alias("train_start"), t(F.col("train_hi") - 1).alias("train_end"),
        t(F.col("test_lo")).alias("test_start"), t(F.col("test_hi") - 1).alias("test_end"),
        F.col("train_hi").alias("train_size"), (F.col("test_hi") - F.col("test_lo")).alias("test_size"))


def fold_metadata(assigned: DataFrame, order: str = "t", by: Keys = ("series_id",)) -> DataFrame:
    """Train/test start, end and size per fold (V5)."""
    ks = [*_keys(by), "fold"]
    tr = F.col("role") != "test"
    te = F.col("role") == "test"
    return assigned.groupBy(*ks).agg(
        F.min(F.when(tr, F.col(order))).alias("train_start"), F.max(F.when(tr, F.col(order))).alias("train_end"),
        F.min(F.when(te, F.col(order))).alias("test_start"), F.max(F.when(te, F.col(order))).alias("test_end"),
        F.count_if(tr).alias("train_size"), F.count_if(te).alias("test_size"))
