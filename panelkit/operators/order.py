"""Order checks and seeded splits over blocks, never over one global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sortedness(df: DataFrame, position: str, value: str, block_rows: int = 65536) -> DataFrame:
    """Is ``value`` non-decreasing in the order of the integer ``position`` (C5)?

    Each block of positions checks itself against the last value of the
    previous block *that has rows* (a lag over the one-row-per-block table), so
    gaps in the positions do not matter.  Rows without a position have no place in
    the order and are not judged.  One row: ``is_sorted`` (NULL for an empty order), ``violations``.
    """
    df = df.where(F.col(position).isNotNull())
    blk = F.floor(F.col(position) / F.lit(block_rows))
    b = df.select(F.col(position).alias("_p"), F.col(value).alias("_v"), blk.alias("_b"))
    last = b.groupBy("_b").agg(F.max_by("_v", "_p").alias("_last"))
    carry = last.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_carry"))
    w = Window.partitionBy("_b").orderBy("_p")
    j = b.join(carry, "_b").withColumn("_prev", F.when(F.row_number().over(w) == 1, F.col("_carry"))
                                       .otherwise(F.lag("_v").over(w)))
    return j.agg(F.bool_and(F.coalesce(F.col("_v") >= F.col("_prev"), F.lit(True))).alias("is_sorted"),
                 F.count_if(F.col("_v") < F.col("_prev")).alias("violations"))


def random_split(df: DataFrame, keys: list[str], share: float = 0.7, seed: int = 42,
                 out: str = "is_train") -> DataFrame:
    """Seeded split with exactly ``floor(share * n)`` train rows (M3).

    Rows are ordered by the md5 of their key and the seed.  Counts per hash
    prefix (4 096 rows) find the one prefix the cut falls into; only its rows
    are numbered.
    """
    h = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    d = df.withColumn("_h", h).withColumn("_x", F.substring("_h", 1, 3))
    counts = d.groupBy("_x").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.orderBy("_x")
    counts = counts.select("_x", (F.sum("_c").over(run) - F.col("_c")).alias("_before"), "_c",
                           F.floor(F.lit(share) * F.sum("_c").over(Window.partitionBy(F.lit(1)))).alias("_cut"))
    j = d.join(counts, "_x")
    inside = (F.col("_before") < F.col("_cut")) & (F.col("_before") + F.col("_c") > F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy("_x").orderBy("_h", *keys))
    return (j.withColumn(out, F.when(inside, F.col("_before") + rank <= F.col("_cut"))
                         .otherwise(F.col("_before") < F.col("_cut")))
            .drop("_h", "_x", "_before", "_c", "_cut"))
