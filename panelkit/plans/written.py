"""Written intermediate tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelkit.session import checkpoint_dir


def _path(df: DataFrame, label: str) -> str:
    return f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: what led to it is not run again,
    and the files outlive any executor."""
    path = _path(df, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_together(df: DataFrame, label: str, keys: Sequence[str], order: str, together: bool = False) -> tuple[DataFrame, DataFrame]:
    """``df`` written in buckets of ``keys``, so that later windows over a series need no exchange, and the same files read
    without regard to the buckets.  Rows are sorted in a bucket, which keeps the files small.  ``together`` says that the
    rows of a series are in one partition already; they are not moved then."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the partitions of an exchange by the keys are the buckets
    path, name = _path(df, label), f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    rows = df if together else df.repartition(n, *keys)
    rows.write.bucketBy(n, *keys).sortBy(*keys, order).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    buckets = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay, and ``buckets`` reads them
    return buckets, spark.read.schema(df.schema).parquet(path)
