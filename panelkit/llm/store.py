"""Written intermediate tables in the session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelkit.session import checkpoint_dir


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet and read it back: the lineage ends at files that
    outlive any executor."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
