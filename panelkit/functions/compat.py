"""Scalar helpers that keep expressions inside Spark's code generation.

Missing-value rule of the engine: NaN and +-inf become NULL at ingest and after
every division or logarithm; "missing" is only ever NULL until a fill runs.
Spark 4 runs with ANSI mode, so plain ``/`` by zero raises; ``safe_div`` uses
``try_divide`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: ColumnOrName) -> Column:
    """NaN and +-inf -> NULL."""
    c = col(c)
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(None).cast("double")).otherwise(c)


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b with NULL for a zero divisor or a non-finite result."""
    return finite(F.try_divide(col(a).cast("double"), col(b).cast("double")))


def clip(c: ColumnOrName, lo: float, hi: float) -> Column:
    """clip(x, lo, hi) that keeps NULL (``greatest`` alone skips NULLs)."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def flag(cond: Column, dtype: str = "int") -> Column:
    """bool -> 0/1 with NULL -> 0."""
    return F.coalesce(cond, F.lit(False)).cast(dtype)


def fill(c: ColumnOrName, value) -> Column:
    """NULL -> constant or column."""
    return F.coalesce(col(c), value if isinstance(value, Column) else F.lit(value))


LARGEST = 1.7976931348623157e308


def sentinel(c: ColumnOrName, value: float) -> Column:
    """+-inf/NaN -> NULL -> constant.  One comparison (NaN is larger than any number), so that many columns stay short code."""
    x = col(c).cast("double")
    return F.coalesce(F.when(F.abs(x) <= LARGEST, x), F.lit(float(value)))


def log1p(c: ColumnOrName) -> Column:
    """log(1 + x); NULL for x <= -1."""
    c = col(c)
    return finite(F.when(c > -1, F.log1p(c)))


def expm1(c: ColumnOrName) -> Column:
    return finite(F.expm1(col(c)))


def hinge(c: ColumnOrName) -> Column:
    """max(0, x) keeping NULL (U8)."""
    c = col(c)
    return F.when(c.isNull(), None).otherwise(F.greatest(c, F.lit(0.0)))


def cap(c: ColumnOrName, hi: float) -> Column:
    c = col(c)
    return F.when(c.isNull(), None).otherwise(F.least(c, F.lit(float(hi))))
