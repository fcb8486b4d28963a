"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.store import stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)``: every node of ``edges(u, v)`` that is not the smallest of its
    component, with that smallest node.  Stars only ever join rows with one row
    per node, so a hub of any size splits over tasks; every round is written."""
    big, small = F.greatest("u", "v"), F.least("u", "v")
    e = stored(edges.where(F.col("u") != F.col("v")).select(big.alias("u"), small.alias("v")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours hang on the smallest one
        e = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(e.where(F.col("u") != F.col("v")).distinct(), "large-star")
        # small star: smaller neighbours and the node itself hang on the smallest one
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")) \
            .unionByName(low.select("u", F.col("m").alias("v")))
        e = stored(e.distinct(), "small-star")
        state, before = _state(e), state
        if state == before:
            break
    return e
