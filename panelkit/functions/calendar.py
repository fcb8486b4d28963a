"""Calendar and grid helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelkit.functions.compat import col


def business_day(offset: Column | str, start: str = "1990-01-01") -> Column:
    """The ``offset``-th business day (Mon-Fri) on or after ``start``.

    Works for any start: the start is moved to its week's Monday and the
    offset is shifted by the start's weekday, so no per-row lookup is needed.
    """
    s = F.to_date(F.lit(start))
    # weekday(): Monday = 0 ... Sunday = 6; a weekend start rolls to Monday
    wd = F.weekday(s)
    monday = F.date_sub(s, wd)
    shift = F.least(wd, F.lit(5))
    n = col(offset).cast("int") + shift
    return F.date_add(monday, (F.floor(n / 5) * 7 + F.pmod(n, F.lit(5))).cast("int"))


def years_between(first: Column | str, last: Column | str) -> Column:
    """Day difference / 365.25."""
    return F.datediff(col(last), col(first)) / F.lit(365.25)


def logspace(start: float, stop: float, num: int) -> Column:
    """Array column ``10 ** linspace(start, stop, num)``."""
    step = (stop - start) / (num - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)),
                       lambda i: F.pow(F.lit(10.0), F.lit(start) + i * F.lit(step)))


def linspace(lo: Column | str, hi: Column | str, num: int) -> Column:
    lo, hi = col(lo), col(hi)
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)),
                       lambda i: lo + (hi - lo) * i / F.lit(num - 1))
