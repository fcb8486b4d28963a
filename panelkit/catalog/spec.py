"""Registered queries: a Spark builder plus its DuckDB twin.

Both sides are wrapped by the same output spec, so names, types and rounding
agree: ``("col", "i")`` -> BIGINT, ``("col", <int>)`` -> DOUBLE rounded to 30
significant bits (about 9 decimal digits) with the same IEEE formula on both
sides: ``floor(x * 2^(30-e) + 0.5) / 2^(30-e)``, ``e = floor(log2|x|)``.  A
binary grid has no exact ties for means of short decimals (they need fewer
bits), and identical doubles round identically.  ``("col", "date")`` -> DATE,
``("col", "s")`` -> STRING, ``("col", "b")`` -> BOOLEAN.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Out = Sequence[tuple[str, object]]
BITS = 30


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    out: Out

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return finalize(self.build(spark, sf_dir), self.out)

    def oracle(self) -> str | None:
        return None if self.sql is None else finalize_sql(self.sql, self.out)


MANY = 8  # so many rounded columns go through one array


def _scale(x: Column) -> Column:
    e = F.greatest(F.least(F.floor(F.log2(F.abs(x))), F.lit(990)), F.lit(-990))
    return F.pow(F.lit(2.0), F.lit(BITS) - e)


def _rounded(x: Column, scale: Column | None = None) -> Column:
    sc = _scale(x) if scale is None else scale
    return F.when(x == 0, F.lit(0.0)).otherwise(F.floor(x * sc + F.lit(0.5)).cast("double") / sc)


def finalize(df: DataFrame, out: Out) -> DataFrame:
    """Names, types and rounding of ``out``.  Many rounded columns are rounded as one array: as single expressions they
    make one very long generated method.  Their scales are an array too, so that each is worked out once."""
    digits = [name for name, fmt in out if isinstance(fmt, int)]
    place = {}
    if len(digits) > MANY:
        others = dict.fromkeys(name for name, fmt in out if not isinstance(fmt, int))
        df = df.select(*others, F.array(*[F.col(n).cast("double") for n in digits]).alias("pk_digits"))
        df = df.select(*others, F.zip_with("pk_digits", F.transform("pk_digits", _scale), _rounded).alias("pk_digits"))
        place = {n: i for i, n in enumerate(digits)}
    cols = []
    for name, fmt in out:
        if name in place:
            cols.append(F.col("pk_digits")[place[name]].alias(name))
            continue
        c = F.col(name)
        if fmt == "i":
            c = c.cast("bigint")
        elif fmt == "date":
            c = c.cast("date")
        elif fmt == "s":
            c = c.cast("string")
        elif fmt == "b":
            c = c.cast("boolean")
        elif isinstance(fmt, int):
            c = _rounded(c.cast("double"))
        cols.append(c.alias(name))
    return df.select(*cols)


def finalize_sql(sql: str, out: Out) -> str:
    exprs = []
    for name, fmt in out:
        q = f'q."{name}"'
        if fmt == "i":
            e = f"CAST({q} AS BIGINT)"
        elif fmt == "date":
            e = f"CAST({q} AS DATE)"
        elif fmt == "s":
            e = f"CAST({q} AS VARCHAR)"
        elif fmt == "b":
            e = f"CAST({q} AS BOOLEAN)"
        elif isinstance(fmt, int):
            x = f"CAST({q} AS DOUBLE)"
            ex = f"greatest(least(floor(log2(abs({x}))), 990), -990)"
            sc = f"pow(CAST(2.0 AS DOUBLE), {BITS} - {ex})"
            e = (f"CASE WHEN {x} = 0 THEN CAST(0.0 AS DOUBLE) "
                 f"ELSE CAST(floor({x} * {sc} + CAST(0.5 AS DOUBLE)) AS DOUBLE) / {sc} END")
        else:
            e = q
        exprs.append(f'{e} AS "{name}"')
    return f"SELECT {', '.join(exprs)} FROM (\n{sql}\n) AS q"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, out: Out):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, out)
        return fn
    return deco
