"""Scans that must not put a whole (possibly hot) series into one task.

* ``row_index``: exact 0-based row number per series.  Rows are bucketed by
  *time value*, counts per (series, bucket) form a small table whose running
  sum gives each bucket's offset; ``row_number`` then runs per (series,
  bucket).  No window ever spans a whole series.
* ``with_blocks`` / ``halo``: row blocks of B rows, and the last k-1 rows of
  each block copied into the next one, so that k-row windows can be computed
  per (series, block) and give exactly the per-series result.
* ``series_pass``: trailing windows, lags, rates and EWMs per (series, block) in one
  Arrow pass, O(n) for every window; EWM states cross blocks through one summary
  row per block.  Matches pandas ``rolling`` and ``ewm(..., ignore_na=False)``.
  Where every series is one block, a window on the series' own keys orders the rows, so
  rows that lie together by (some of) these keys are not moved again.
* ``carry``: running sums, extremes and last values as a scan over blocks, all in
  JVM expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions import series
from panelkit.operators.rolling import Keys, _keys
from panelkit.plans.written import written

DEFAULT_BLOCK_ROWS = 1 << 16


def time_bucket(df: DataFrame, order: str, span: int = 1024) -> F.Column:
    """Bucket of the order key holding at most ``span`` distinct time steps."""
    dt = df.schema[order].dataType
    if isinstance(dt, T.DateType):
        v = F.unix_date(F.col(order)).cast("long")
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        v = F.unix_micros(F.col(order).cast("timestamp"))
        span = span * 3_600_000_000  # hourly steps
    else:
        v = F.col(order).cast("long")
    return F.floor(v / F.lit(span)).cast("long")


def one_key(keys: Sequence[str]) -> F.Column:
    """All keys as one struct: equal also where keys are NULL, so joins and windows
    on it share one partitioning."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))


def row_index(df: DataFrame, keys: Keys = "series_id", order: str = "t", out: str = "rn",
              bucket_span: int = 1024, size: str | None = None, longest: int | None = None) -> DataFrame:
    """Add the exact 0-based position of each row inside its series (and, as ``size``,
    the number of placed rows of the series).

    No row is lost: rows with NULL keys form one series, rows with a NULL order
    value keep a NULL position (and are spread, as they need no numbering).
    ``longest`` is the longest series' length, where it is known: series that fit a block are numbered
    by one window each, which leaves rows that lie together by the keys where they are.
    """
    ks = _keys(keys)
    b = _bucketed(df, ks, order, bucket_span)
    if longest is not None and longest <= DEFAULT_BLOCK_ROWS and not size:
        return _carry_short(b, [{out: ("sum", F.lit(1))}], ks, order).select(*df.columns, (F.col(out) - 1).cast("long").alias(out))
    counts = b.where(F.col(order).isNotNull()).groupBy("pk_key", "pk_tb").agg(F.count(F.lit(1)).alias("pk_c"))
    wo = Window.partitionBy("pk_key").orderBy("pk_tb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("pk_key", "pk_tb", F.coalesce(F.sum("pk_c").over(wo), F.lit(0)).alias("pk_off"),
                         F.sum("pk_c").over(Window.partitionBy("pk_key")).alias("pk_size"))
    wr = Window.partitionBy("pk_key", "pk_tb").orderBy(order)
    extra = [F.col("pk_size").alias(size)] if size else []
    # rows without a time find no offset
    return b.join(offs, ["pk_key", "pk_tb"], "left").select(
        *df.columns, (F.col("pk_off") + F.row_number().over(wr) - 1).cast("long").alias(out), *extra)


def _bucketed(df: DataFrame, ks: Sequence[str], order: str, span: int) -> DataFrame:
    """``df`` with its key as one column and a time bucket; rows without a time are spread over buckets of their own."""
    none = F.lit(-(1 << 62)) - F.monotonically_increasing_id() % 1024
    return df.select("*", one_key(ks).alias("pk_key"), F.when(F.col(order).isNull(), none).otherwise(
        time_bucket(df, order, span)).alias("pk_tb"))


def with_blocks(df: DataFrame, block_rows: int, rn: str = "rn", out: str = "blk") -> DataFrame:
    return df.withColumn(out, F.floor(F.col(rn) / F.lit(block_rows)).cast("long"))


def halo(df: DataFrame, k: int, block_rows: int, rn: str = "rn", blk: str = "blk", home: str = "_home") -> DataFrame:
    """Copy the last k-1 rows of every block into the next block.

    Adds ``home`` (true for the row's own block).  After windowing by
    (keys, blk) ordered by ``rn``, keep ``home`` rows only.
    """
    if k - 1 > block_rows:
        raise ValueError("block must hold at least k-1 rows")
    pos = F.col(rn) % F.lit(block_rows)
    tail = pos >= F.lit(block_rows - (k - 1))
    copies = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (df.withColumn("_d", F.explode(copies))
            .withColumn(blk, F.col(blk) + F.col("_d"))
            .withColumn(home, F.col("_d") == 0).drop("_d"))


# --------------------------------------------------------------------------- EWM


def alpha_of(span: float | None = None, com: float | None = None, alpha: float | None = None) -> float:
    if span is not None:
        return 2.0 / (span + 1.0)
    if com is not None:
        return 1.0 / (1.0 + com)
    if alpha is None:
        raise ValueError("give span, com or alpha")
    return float(alpha)


# ------------------------------------------------------------ scans in the JVM

#: kind -> (over a frame of rows, over a block's rows, over the blocks before, carried in and local value)
_both = lambda f, zero: lambda pre, own: F.when(
    pre.isNotNull() | own.isNotNull(), f(F.coalesce(pre, F.lit(zero)), F.coalesce(own, F.lit(zero))))
_SCANS = {
    "sum": (F.sum, lambda x, o: F.sum(x), F.sum, _both(lambda a, b: a + b, 0)),
    "product": (F.product, lambda x, o: F.product(x), F.product, _both(lambda a, b: a * b, 1.0)),
    "max": (F.max, lambda x, o: F.max(x), F.max, lambda pre, own: F.greatest(pre, own)),
    "min": (F.min, lambda x, o: F.min(x), F.min, lambda pre, own: F.least(pre, own)),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda x, o: F.max_by(x, F.when(x.isNotNull(), o)),
             lambda x: F.last(x, ignorenulls=True), lambda pre, own: F.coalesce(own, pre)),
    "next": (lambda x: F.first(x, ignorenulls=True), lambda x, o: F.min_by(x, F.when(x.isNotNull(), o)),
             lambda x: F.first(x, ignorenulls=True), lambda pre, own: F.coalesce(own, pre)),
}


def carry(df: DataFrame, *stages: Mapping[str, tuple[str, F.Column | str]], keys: Keys = "series_id", order: str = "t",
          span: int = 1024, longest: int | None = None) -> DataFrame:
    """Add running values per series: name -> (kind, value), kinds ``sum``, ``product``, ``max``, ``min``, ``last``
    (non-NULL so far), ``next`` (first non-NULL from here on) and ``lag`` (the row before).

    A block is the rows of one series within ``span`` time steps.  Windows run inside
    blocks; one summary row per block is scanned per series, and what it carries into a
    block is combined with the local value.  So a hot series spreads over tasks.
    Later stages may use the names of earlier ones; all share one exchange.
    Where no series has more than ``span`` rows, each is one block: plain windows on one sort, nothing is summed up or joined,
    and rows that lie together by the keys stay where they are.
    Rows without a time belong to no order and get NULLs.
    """
    ks = _keys(keys)
    out = _bucketed(df, ks, order, span)
    if (longest_series(df, ks, order) if longest is None else longest) <= span:
        return _carry_short(out, stages, ks, order).drop("pk_key", "pk_tb")
    block = ["pk_key", "pk_tb"]
    rows = Window.partitionBy(*block).orderBy(order)
    blocks = Window.partitionBy("pk_key").orderBy("pk_tb")
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    for outs in stages:
        sums, ins, done = [], [], {}
        for i, (name, (kind, x)) in enumerate(outs.items()):
            x, inside, before = (F.col(x) if isinstance(x, str) else x), f"pk_s{i}", f"pk_i{i}"
            if kind == "lag":
                sums.append(F.max_by(F.struct(x.alias("v")), F.col(order)).alias(inside))
                ins.append(F.lag(inside).over(blocks)["v"].alias(before))
                first = F.row_number().over(rows) == 1
                done[name] = F.when(first, F.col(before)).otherwise(F.lag(x).over(rows))
                continue
            local, total, prefix, both = _SCANS[kind]
            sums.append(total(x, F.col(order)).alias(inside))
            ahead = kind == "next"
            ins.append(prefix(F.col(inside)).over(blocks.rowsBetween(1, end) if ahead else blocks.rowsBetween(start, -1)).alias(before))
            done[name] = both(F.col(before), local(x).over(rows.rowsBetween(0, end) if ahead else rows.rowsBetween(start, 0)))
        into = out.where(F.col(order).isNotNull()).groupBy(*block).agg(*sums).select(*block, *ins)
        done = {n: F.when(F.col(order).isNotNull(), c) for n, c in done.items()}
        out = out.join(into, block, "left").withColumns(done).drop(*[f"pk_i{i}" for i in range(len(outs))])
    return out.drop(*block)


def _carry_short(out: DataFrame, stages: Sequence[Mapping], ks: Sequence[str], order: str) -> DataFrame:
    """``carry`` where every series is one block; rows without a time stay in buckets of their own."""
    rows = Window.partitionBy(*ks, "pk_tb").orderBy(order)  # by the keys themselves: NULLs are equal in a window
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    out = out.withColumn("pk_tb", F.when(F.col(order).isNull(), F.col("pk_tb")).otherwise(F.lit(0).cast("long")))
    for outs in stages:
        done = {}
        for name, (kind, x) in outs.items():
            x = F.col(x) if isinstance(x, str) else x
            c = F.lag(x).over(rows) if kind == "lag" else _SCANS[kind][0](x).over(
                rows.rowsBetween(0, end) if kind == "next" else rows.rowsBetween(start, 0))
            done[name] = F.when(F.col(order).isNotNull(), c)
        out = out.withColumns(done)
    return out


# ------------------------------------------------------- one pass over blocks


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the groups' first rows, from rows sorted by ``keys`` (NULLs are equal).
    A table holds the groups that end in one Arrow batch, so many short groups cost one call."""
    def change(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
        out = pc.fill_null(pc.not_equal(a, b), False).to_numpy() | (pc.is_null(a).to_numpy() != pc.is_null(b).to_numpy())
        if pa.types.is_floating(a.type):
            out &= ~(pc.fill_null(pc.is_nan(a), False).to_numpy() & pc.fill_null(pc.is_nan(b), False).to_numpy())
        return out

    held: list[pa.Table] = []  # parts of one group that is still open
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        head = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), t]) if held else t
        new = np.zeros(head.num_rows - 1, bool)
        for k in keys:
            c = head.column(k)
            new |= change(c.slice(0, len(c) - 1), c.slice(1))
        cuts = np.flatnonzero(new) + (0 if held else 1)  # rows of t that begin a group
        if not len(cuts):
            held.append(t)
            continue
        before = sum(h.num_rows for h in held)
        out = pa.concat_tables([*held, t.slice(0, cuts[-1])])
        yield out.combine_chunks(), np.append(0, cuts[:-1] + before)
        held = [t.slice(cuts[-1])]
    if held:
        yield pa.concat_tables(held).combine_chunks(), np.zeros(1, int)


def by_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | F.Column], fn, schema) -> DataFrame:
    """``fn(table, first rows of the groups)`` over whole groups of ``keys``, sorted by ``order`` inside."""
    def run(batches):
        for t, starts in _groups(batches, keys):
            yield from fn(t, starts).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class _Block:
    """The rows of several (series, block) groups, one after the other and in order, each with the halo before it."""

    def __init__(self, t: pa.Table, starts: np.ndarray, rn: str | None):
        self.table, self.starts = t, starts
        self.ends = np.append(starts[1:], t.num_rows)
        self.place = np.arange(t.num_rows) - np.repeat(starts, self.ends - starts)
        self.rn = self.place if rn is None else pc.fill_null(t.column(rn), -1).to_numpy()
        self.home = t.column(_HOME).to_numpy().astype(bool) if _HOME in t.column_names else np.ones(t.num_rows, bool)
        self.cache: dict = {}

    def groups(self) -> Iterator[tuple[int, np.ndarray]]:
        """Every group's first row and its home rows."""
        for a, z in zip(self.starts, self.ends):
            yield a, a + np.flatnonzero(self.home[a:z])

    def values(self, name: str, shift: int = 0) -> np.ndarray:
        if (name, shift) not in self.cache:
            if shift:
                x = series.shifted(self.values(name), shift, self.place)
            else:
                x = np.array(self.table.column(name).cast(pa.float64()).to_numpy(), float)
                x[~np.isfinite(x)] = np.nan
            self.cache[name, shift] = x
        return self.cache[name, shift]

    def trailing(self, name: str, shift: int, k: int, mp: int | None) -> dict:
        key = (name, shift, k, mp, "trailing")
        if key not in self.cache:
            self.cache[key] = series.trailing(self.values(name, shift), k, mp, self.place)
        return self.cache[key]

    def stat(self, w: "Stat") -> np.ndarray:
        if w.kind == "corr":
            return series.trailing_corr(self.values(w.value, w.shift), self.values(w.other, w.shift), w.k, w.min_periods, self.place)
        if w.kind == "lag":
            return self.values(w.value, w.shift + w.k)
        if w.kind == "roc":
            return series.rate(self.values(w.value, w.shift), w.k, self.place)
        return self.trailing(w.value, w.shift, w.k, w.min_periods)[w.kind]


@dataclass(frozen=True)
class Stat:
    """One output column: ``kind`` is mean, std, sum, corr (with ``other``), lag or roc over the
    trailing ``k`` rows of ``value`` taken ``shift`` rows earlier; ``min_periods`` is ``k`` by default."""

    kind: str
    value: str
    k: int
    min_periods: int | None = None
    shift: int = 0
    other: str | None = None


@dataclass(frozen=True)
class Ewm:
    """Exponentially weighted mean of ``value`` taken ``shift`` rows earlier."""

    value: str
    alpha: float
    adjust: bool = False
    shift: int = 0


_HOME, _BLK, _N, _RN, _ST, _AT = "pk_home", "pk_blk", "pk_n", "pk_rn", "pk_states", "pk_at"
WIDEST = 256  # so many columns a Python call returns of a block of ``DEFAULT_BLOCK_ROWS``


def series_pass(df: DataFrame, outs: Mapping[str, Stat | Ewm], keys: Keys = "series_id", order: str = "t",
                block_rows: int = DEFAULT_BLOCK_ROWS, rn: str | None = None, longest: int | None = None) -> DataFrame:
    """Add all ``outs`` in one pass over (series, block) groups.

    Every block sees the last rows of the one before (a halo of the longest
    window), so no group holds more than ``block_rows`` plus the halo, however
    long the series, and one exchange serves all columns.  A Python call works on all
    groups of an Arrow batch at once.  The longest series is looked up first: if it fits a block, rows need no
    numbers and no halo, their places follow from the order, and only the values go to Python.  EWMs need the state at the
    block's start: for series of several blocks the numbered rows are written once, a narrow pass sums each block up in one
    row, and a walk over those rows gives the states.
    ``rn`` names a 0-based row position; otherwise it is computed.  Rows without
    a position get NULLs.  ``longest`` is the longest series' length, where it is known.
    """
    ks = _keys(keys)
    outs = dict(outs)
    ewms = {n: o for n, o in outs.items() if isinstance(o, Ewm)}
    reach = max([o.shift + (o.k if isinstance(o, Stat) else 0) for o in outs.values()] + [1])
    block_rows = max(block_rows, reach)
    own = df.columns
    spread = -1 - F.monotonically_increasing_id() % 1024  # rows without a position are spread over blocks of their own
    if rn is None and (longest_series(df, ks, order) if longest is None else longest) <= block_rows:
        return _short_pass(df.withColumn(_BLK, F.when(F.col(order).isNotNull(), F.lit(0).cast("long")).otherwise(spread)), outs, ks, order)
    block_rows = max(min(block_rows, block_rows * WIDEST // len(outs)), reach)
    base, rcol = (_sized(df, ks, rn) if ewms else df, rn) if rn else (row_index(df, ks, order, out=_RN, size=_N), _RN)
    placed = with_blocks(base, block_rows, rcol, _BLK).withColumn(_BLK, F.coalesce(_BLK, spread))
    if ewms:
        placed = written(placed, "placed-rows")
    rows = halo(placed, reach + 1, block_rows, rcol, _BLK, _HOME).select(*own, *([] if rn else [_RN]), _BLK, _HOME)
    states = _block_states(placed.where((F.col(_N) > block_rows) & F.col(rcol).isNotNull()), ewms, ks, rcol, block_rows, reach) \
        if ewms else None
    marked = states is not None
    if marked:  # a block's states are a row before its rows
        rows = rows.withColumn(_ST, F.lit(None).cast(_STATES_SQL)).unionByName(states, allowMissingColumns=True)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in outs)])

    def blocks(t: pa.Table, starts: np.ndarray) -> pa.Table:
        begin: dict = {}
        if marked:
            marks = pc.is_valid(t.column(_ST)).to_numpy()
            at = np.flatnonzero(marks)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
            begin = dict(zip(group[at].tolist(), t.column(_ST).take(pa.array(at)).to_pylist()))
            gone = np.append(0, np.cumsum(marks))
            t, starts = t.filter(pa.array(~marks)).combine_chunks(), starts - gone[starts]
        b = _Block(t, starts, rcol)
        none = t.column(_BLK).to_numpy() < 0
        cols = {n: b.stat(o) for n, o in outs.items() if isinstance(o, Stat)}
        cols.update({n: np.full(t.num_rows, np.nan) for n in ewms})
        for g, (a, home) in enumerate(b.groups() if ewms else ()):
            if len(home) and not none[a]:
                for (n, o), st in zip(ewms.items(), begin.get(g) or [None] * len(ewms)):
                    cols[n][home], _ = series.ewm(b.values(o.value, o.shift)[home], b.rn[home], o.alpha, o.adjust, _state(st))
        out = t.select(own)
        for n in outs:
            out = out.append_column(n, pa.array(cols[n], pa.float64(), mask=np.isnan(cols[n]) | none))
        return out if b.home.all() else out.filter(pa.array(b.home))

    first = [F.col(_ST).isNull()] if marked else []
    return by_group(rows, [*ks, _BLK], [*first, rcol], blocks, schema)


def _short_pass(rows: DataFrame, outs: dict[str, Stat | Ewm], ks: Sequence[str], order: str) -> DataFrame:
    """``series_pass`` where every series is one block.  A window places the rows, which moves them only if they do not lie
    together by the keys; the values go to Python in that order, batch by batch, and a series is worked out where it ends.
    Rows without a time are alone.  Columns beyond ``WIDEST`` come from further calls."""
    at = F.when(F.col(_BLK) < 0, -1).otherwise(F.row_number().over(Window.partitionBy(*ks, _BLK).orderBy(order)) - 1)
    rows = rows.withColumn(_AT, at)
    names = list(outs)
    parts = [{n: outs[n] for n in names[i: i + WIDEST]} for i in range(0, len(names), WIDEST)]
    for i, part in enumerate(parts):
        values = list(dict.fromkeys(v for o in part.values() for v in (o.value, getattr(o, "other", None)) if v))
        rows = rows.withColumn(f"pk_part{i}", _series_udf(part, values)(_AT, *[F.col(v).cast("double") for v in values]))
    done = {n: F.col(f"pk_part{i}")[n] for i, part in enumerate(parts) for n in part}
    return rows.withColumns(done).drop(_BLK, _AT, *[f"pk_part{i}" for i in range(len(parts))])


def _series_udf(outs: Mapping[str, Stat | Ewm], values: Sequence[str]):
    """The columns ``outs`` as one struct, from the rows' places (0 begins a series, -1 stands alone) and ``values``.
    Not deterministic for the optimizer: no filter may go below it and take rows out of the windows."""
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held: list[pa.Table] = []  # parts of the series that is still open
        for cols in batches:
            t = pa.Table.from_arrays(list(cols), [_AT, *values])
            begins = np.flatnonzero(t.column(_AT).to_numpy() <= 0)
            if len(begins):
                yield from columns([*held, t.slice(0, begins[-1])])
                held = []
            held.append(t.slice(begins[-1]) if len(begins) else t)
        yield from columns(held)

    def columns(parts: list[pa.Table]) -> Iterator[pa.Array]:
        if not sum(p.num_rows for p in parts):
            return
        t = pa.concat_tables(parts).combine_chunks()
        at = t.column(_AT).to_numpy()
        b, none = _Block(t, np.flatnonzero(at <= 0), None), at < 0
        cols = {n: b.stat(o) if isinstance(o, Stat) else np.full(len(at), np.nan) for n, o in outs.items()}
        for n, o in outs.items():
            if isinstance(o, Ewm):
                x = b.values(o.value, o.shift)
                for a, z in zip(b.starts, b.ends):
                    if not none[a]:
                        cols[n][a:z], _ = series.ewm(x[a:z], b.place[a:z], o.alpha, o.adjust, _state(None))
        yield pa.StructArray.from_arrays([pa.array(c, pa.float64(), mask=np.isnan(c) | none) for c in cols.values()], list(cols))

    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in outs])
    return F.arrow_udf(run, schema).asNondeterministic()


def longest_series(df: DataFrame, keys: Keys = "series_id", order: str = "t") -> int:
    """Rows of the longest series, rows without a time aside."""
    ks = _keys(keys)
    n = df.where(F.col(order).isNotNull()).groupBy(one_key(ks).alias("pk_key")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max("n")).first()[0] or 0


def _sized(df: DataFrame, ks: list[str], rn: str) -> DataFrame:
    """``df`` with the number of placed rows of each series."""
    n = df.groupBy(one_key(ks).alias("pk_key")).agg(F.count(rn).alias(_N))
    return df.withColumn("pk_key", one_key(ks)).join(n, "pk_key").drop("pk_key")


def _state(s: dict | None) -> tuple:
    return (None, None, 0.0) if s is None or s["last"] is None else (s["last"], s["mean"], s["weight"])


_STATES = pa.list_(pa.struct([("last", pa.int64()), ("mean", pa.float64()), ("weight", pa.float64())]))
_STATES_SQL = "array<struct<last: long, mean: double, weight: double>>"


def _block_states(placed: DataFrame, ewms: Mapping[str, Ewm], ks: list[str], rn: str, block_rows: int, reach: int) -> DataFrame:
    """``(keys, block, states)``: the state of every EWM at the start of each block.

    A block is summed up by what it does to any state: where its values begin and
    end, the first one, and the affine map of the mean (and of the weight)."""
    values = list(dict.fromkeys(o.value for o in ewms.values()))
    rows = halo(placed.select(*ks, rn, _BLK, *values), reach + 1, block_rows, rn, _BLK, _HOME)
    kf = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in ks)
    gk = [*ks, _BLK]
    part = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("x", pa.float64()),
                               *((c, pa.float64()) for c in ("c", "d", "wc", "wd"))]))

    def summary(t: pa.Table, starts: np.ndarray) -> pa.Table:
        b = _Block(t, starts, rn)
        out = [parts_of(b, home) for _, home in b.groups()]
        at = pa.array(starts)
        return pa.table([*(t.column(k).take(at) for k in gk), pa.array(out, part)], names=[*gk, "parts"]).filter(
            pa.array([any(h) for h in (b.home[a:z] for a, z in zip(b.starts, b.ends))]))

    def parts_of(b: _Block, home: np.ndarray) -> list:
        out = []
        for o in ewms.values():
            x, at = b.values(o.value, o.shift)[home], b.rn[home]
            have = np.flatnonzero(~np.isnan(x))
            if not len(have):
                out.append(None)
                continue
            v, pos = x[have], at[have]
            w = (1.0 - o.alpha) ** np.diff(pos).astype(float)
            if o.adjust:  # weighted sums relative to the first value
                c, d = series.affine(np.append(1.0, w), np.append(0.0, v[1:] - v[0]))
                wc, wd = series.affine(np.append(1.0, w), np.append(0.0, np.ones(len(w))))
            else:
                c, d = series.affine(np.append(1.0, w / (w + o.alpha)), np.append(0.0, o.alpha / (w + o.alpha) * (v[1:] - v[0])))
                wc = wd = np.zeros(1)
            out.append({"first": int(pos[0]), "last": int(pos[-1]), "x": v[0], "c": c[-1], "d": d[-1], "wc": wc[-1], "wd": wd[-1]})
        return out

    sums = by_group(rows, gk, [rn], summary, f"{kf}, {_BLK} long, parts array<struct<first: long, last: long, x: double, c: double, d: double, wc: double, wd: double>>")

    def walk(t: pa.Table, starts: np.ndarray) -> pa.Table:
        out, begins = [], set(starts.tolist())
        for i, parts in enumerate(t.column("parts").to_pylist()):
            now = [_state(None)] * len(ewms) if i in begins else now
            out.append([{"last": s[0], "mean": s[1], "weight": s[2]} for s in now])
            now = [_after(s, p, o) for s, p, o in zip(now, parts, ewms.values())]
        return t.select(gk).append_column(_ST, pa.array(out, _STATES))

    return by_group(sums, ks, [_BLK], walk, f"{kf}, {_BLK} long, {_ST} {_STATES_SQL}")


def _after(state: tuple, p: dict | None, o: Ewm) -> tuple:
    """The state after a block that began with ``state``."""
    if p is None:
        return state
    last, mean, weight = state
    w = 0.0 if last is None else (1.0 - o.alpha) ** float(p["first"] - last)
    dev = 0.0 if mean is None else mean - p["x"]  # deviations from the block's first value
    if not o.adjust:
        return p["last"], p["x"] + p["c"] * (w / (w + o.alpha) * dev) + p["d"], 1.0
    weight = w * weight  # of what came before, at the first value
    total = p["wc"] * (weight + 1) + p["wd"]
    return p["last"], p["x"] + (p["c"] * weight * dev + p["d"]) / total, total


def ewm(df: DataFrame, value: str, alphas: Mapping[str, float], adjust: bool = False, keys: Keys = "series_id",
        order: str = "t", block_rows: int = DEFAULT_BLOCK_ROWS, rn: str | None = None) -> DataFrame:
    """Add one EWM-mean column per ``alphas`` entry (name -> alpha); every input row and column stays."""
    return series_pass(df, {n: Ewm(value, float(a), adjust) for n, a in alphas.items()}, keys, order, block_rows, rn)


def ewm_spans(df: DataFrame, value: str, spans: Mapping[str, float], adjust: bool = False,
              **kw) -> DataFrame:
    return ewm(df, value, {n: alpha_of(span=s) for n, s in spans.items()}, adjust, **kw)


def rolling_blocked(df: DataFrame, cols: Mapping[str, tuple[str, str, int, int | None]],
                    keys: Keys = "series_id", order: str = "t",
                    block_rows: int = DEFAULT_BLOCK_ROWS, rn: str | None = None) -> DataFrame:
    """``cols``: out name -> (mean, std or sum; value column; k; min_periods)."""
    return series_pass(df, {n: Stat(*c) for n, c in cols.items()}, keys, order, block_rows, rn)


def window_stats(df: DataFrame, value: str, windows: Sequence[int], lags: Sequence[int], keys: Keys, rn: str,
                 min_periods: int | None = None, prefix: str = "", shifted: str = "_u",
                 block_rows: int = DEFAULT_BLOCK_ROWS, ewms: Mapping[str, float] | None = None) -> DataFrame:
    """Lagged, rolling and rate-of-change statistics of ``value`` in one pass (see ``shifted_stats``)."""
    return series_pass(df, shifted_stats(value, windows, lags, min_periods, prefix, shifted, ewms or {}), keys, rn, block_rows, rn)


def shifted_stats(value: str, windows: Sequence[int], lags: Sequence[int], min_periods: int | None = None,
                  prefix: str = "", shifted: str | None = None, ewms: Mapping[str, float] | None = None) -> dict[str, Stat | Ewm]:
    """With u = lag(value, 1): ``mean_k``, ``std_k``, ``cum_k`` (trailing k rows of u) and ``roc_k`` = u / lag(u, k) - 1
    for every window, ``lag_j`` = lag(value, j), EWMs of u, and u itself as ``shifted``."""
    outs: dict[str, Stat | Ewm] = {shifted: Stat("lag", value, 1)} if shifted else {}
    for k in windows:
        for name, kind in (("mean", "mean"), ("std", "std"), ("roc", "roc"), ("cum", "sum")):
            outs[f"{prefix}{name}_{k}"] = Stat(kind, value, k, min_periods, shift=1)
    outs.update({f"{prefix}lag_{j}": Stat("lag", value, j) for j in lags})
    outs.update({f"{prefix}{n}": Ewm(value, a, shift=1) for n, a in (ewms or {}).items()})
    return outs
