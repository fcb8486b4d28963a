"""Row-based window operators on ordered series.

Every operator takes the series keys and the order key as arguments and is
expressed with Spark window functions, so rows of one series are shuffled
together once and all frames of one ``WindowSpec`` share one Exchange + Sort
+ Window node.  Keep the spec textually identical across expressions.  These
expressions recompute a frame per row and keep a series in one task: for long
windows or series use ``rolling`` and ``scan.series_pass`` / ``scan.carry``.

Frames are row frames ``rowsBetween(-(k-1), 0)`` as in pandas ``rolling(k)``.
``min_periods`` follows pandas: a frame with fewer non-null values yields NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelkit.functions.compat import ColumnOrName, col, finite, safe_div

Keys = str | Sequence[str]


def _keys(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def series_window(keys: Keys = "series_id", order: str = "t") -> WindowSpec:
    ks = _keys(keys)
    w = Window.partitionBy(*ks) if ks else Window.partitionBy()
    return w.orderBy(order)


def frame(w: WindowSpec, k: int) -> WindowSpec:
    """Trailing frame of k rows, current row included."""
    return w.rowsBetween(-(k - 1), 0)


def _guard(x: Column, w: WindowSpec, k: int, min_periods: int | None, agg: Column) -> Column:
    mp = k if min_periods is None else min_periods
    return F.when(F.count(x).over(frame(w, k)) >= mp, agg)


def roll_mean(x: ColumnOrName, k: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    x = col(x)
    return _guard(x, w, k, min_periods, F.avg(x).over(frame(w, k)))


def roll_std(x: ColumnOrName, k: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    """Sample std (ddof=1); a frame with one value gives NULL as in pandas."""
    x = col(x)
    return _guard(x, w, k, min_periods, F.stddev_samp(x).over(frame(w, k)))


def roll_sum(x: ColumnOrName, k: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    x = col(x)
    return _guard(x, w, k, min_periods, F.sum(x).over(frame(w, k)))


def roll_min(x: ColumnOrName, k: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    x = col(x)
    return _guard(x, w, k, min_periods, F.min(x).over(frame(w, k)))


def roll_max(x: ColumnOrName, k: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    x = col(x)
    return _guard(x, w, k, min_periods, F.max(x).over(frame(w, k)))


def roll_corr(a: ColumnOrName, b: ColumnOrName, k: int, w: WindowSpec,
              min_periods: int | None = None) -> Column:
    """Rolling Pearson correlation over rows where both are present."""
    a, b = col(a), col(b)
    both = F.when(a.isNotNull() & b.isNotNull(), F.lit(1))
    mp = k if min_periods is None else min_periods
    return finite(F.when(F.count(both).over(frame(w, k)) >= mp, F.corr(a, b).over(frame(w, k))))


def roll_rmse(err: ColumnOrName, k: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    """sqrt of the rolling mean of squared errors."""
    e = col(err)
    return F.sqrt(roll_mean(e * e, k, w, min_periods))


def lag(x: ColumnOrName, n: int, w: WindowSpec) -> Column:
    """shift(n): counts NULL rows as rows."""
    return F.lag(col(x), n).over(w)


def roc(x: ColumnOrName, k: int, w: WindowSpec) -> Column:
    """x / lag(x, k) - 1 with NULL for a zero or missing base."""
    x = col(x)
    return safe_div(x, F.lag(x, k).over(w)) - 1


def pct_change(x: ColumnOrName, w: WindowSpec) -> Column:
    """Percent change with the first row -> 0."""
    return F.coalesce(roc(x, 1, w), F.lit(0.0))


def diff(x: ColumnOrName, w: WindowSpec, n: int = 1) -> Column:
    x = col(x)
    return x - F.lag(x, n).over(w)


def cumprod(x: ColumnOrName, w: WindowSpec) -> Column:
    """Running product (W11); NULL factors are skipped like pandas cumprod."""
    return F.product(col(x)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def cummax(x: ColumnOrName, w: WindowSpec) -> Column:
    return F.max(col(x)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(equity: ColumnOrName, w: WindowSpec) -> Column:
    """equity / running max - 1."""
    e = col(equity)
    return safe_div(e, cummax(e, w)) - 1


def ffill(x: ColumnOrName, w: WindowSpec) -> Column:
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def bfill(x: ColumnOrName, w: WindowSpec) -> Column:
    """Back-fill: looks ahead by construction; use for research views only."""
    return F.first(col(x), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def bfill_ffill(x: ColumnOrName, w: WindowSpec) -> Column:
    """Back-fill then forward-fill."""
    b = bfill(x, w)
    # forward fill of the back-filled series equals: back-filled value, or the
    # last non-null value of x when nothing follows
    return F.coalesce(b, ffill(x, w))


def expanding_mean(x: ColumnOrName, w: WindowSpec, include_current: bool = False) -> Column:
    """Mean of all earlier rows (no look-ahead); used for P9."""
    hi = 0 if include_current else -1
    return F.avg(col(x)).over(w.rowsBetween(Window.unboundedPreceding, hi))


def row_index(w: WindowSpec) -> Column:
    """0-based position within the series."""
    return (F.row_number().over(w) - 1).cast("bigint")


def directional_hit(y: ColumnOrName, yhat: ColumnOrName) -> Column:
    """1 when sign(y) == sign(yhat)."""
    return (F.signum(col(y)) == F.signum(col(yhat))).cast("int")


def rolling(df: DataFrame, value: str, windows: Sequence[int],
            stats: Sequence[str] = ("mean", "std", "sum"), min_periods: int | None = None,
            keys: Keys = "series_id", order: str = "t", prefix: str | None = None) -> DataFrame:
    """Add ``{prefix}_{stat}_{k}`` columns for every window k (W2-W4): mean, std or sum,
    O(n) whatever the windows, in blocks (``scan.series_pass``)."""
    from panelkit.plans import scan
    p = prefix or value
    return scan.series_pass(df, {f"{p}_{s}_{k}": scan.Stat(s, value, k, min_periods) for k in windows for s in stats}, keys, order)


def lags(df: DataFrame, value: str, ns: Sequence[int], keys: Keys = "series_id",
         order: str = "t", prefix: str | None = None) -> DataFrame:
    w = series_window(keys, order)
    p = prefix or value
    return df.withColumns({f"{p}_lag_{n}": lag(value, n, w) for n in ns})


def join_same(df: DataFrame, other: DataFrame, keys: Keys, how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` where NULL equals NULL, so rows with NULL keys keep
    their group; ``other``'s key columns are dropped."""
    ks = _keys(keys)
    renamed = other.withColumnsRenamed({k: f"pk_r_{k}" for k in ks})
    on = [F.col(k).eqNullSafe(F.col(f"pk_r_{k}")) for k in ks]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(renamed, cond, how).drop(*[f"pk_r_{k}" for k in ks])


def attach(df: DataFrame, stats: DataFrame, keys: Keys) -> DataFrame:
    """Join per-group statistics back to rows; every row of ``df`` stays.

    With keys: a NULL-safe equi-join (AQE broadcasts the stats side only when
    its measured size is under the broadcast threshold).  Without keys the
    stats table is one aggregate row, so it is broadcast on a constant key.
    """
    ks = _keys(keys)
    if ks:
        return join_same(df, stats, ks)
    one = F.lit(1).alias("pk_one")
    return (df.select("*", one).join(F.broadcast(stats.select("*", one)), "pk_one", "left")
            .drop("pk_one"))
