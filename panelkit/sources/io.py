"""Sources and sinks.

Readers take explicit schemas (inference only for discovery); writers are
idempotent (overwrite of a named folder) so a retried job after an executor
loss rewrites the same output instead of appending duplicates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions.compat import finite

ERROR_DETAILS_MAX = 8000


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row (A1).  Without a schema every column is a string,
    to be cast with ``lenient_cast``."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema is not None else r).csv(path)


def lenient_cast(df: DataFrame, keep: Sequence[str] = ("date_id",), dtype: str = "double") -> DataFrame:
    """Cast every column but ``keep`` to double; bad values -> NULL (A2).

    ``try_cast`` keeps ANSI mode from raising; NaN / inf become NULL too.
    """
    out = []
    for c in df.columns:
        if c in keep:
            out.append(F.col(c))
        else:
            v = F.expr(f"try_cast(`{c}` AS {dtype})")
            out.append((finite(v) if dtype == "double" else v).alias(c))
    return df.select(*out)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Label harmonisation (A3)."""
    return df.withColumnsRenamed(dict(mapping))


def submission_frame(predictions: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Id columns first, then the other columns (A4 layout)."""
    rest = [c for c in predictions.columns if c not in ids]
    return predictions.select(*ids, *rest)


def write_submission(predictions: DataFrame, ids: Sequence[str], path: str) -> None:
    """Parquet submission sink (A4); overwrite keeps retries idempotent."""
    submission_frame(predictions, ids).write.mode("overwrite").parquet(path)


def run_result(status: DataFrame) -> DataFrame:
    """One-row run result from a status table with ``status`` per group (A5)."""
    bad = F.col("status") != "ok"
    a = status.agg(F.count_if(bad).alias("_bad"),
                   F.array_join(F.sort_array(F.collect_set(F.when(bad, F.col("status")))), "; ").alias("_det"))
    return a.select((F.col("_bad") == 0).alias("Succeeded"),
                    F.when(F.col("_bad") == 0, 0).otherwise(1).alias("ErrorType"),
                    F.when(F.col("_bad") == 0, F.lit(None).cast("string")).otherwise(F.lit("InvalidSubmission")).alias("ErrorName"),
                    F.substring(F.col("_det"), 1, ERROR_DETAILS_MAX).alias("ErrorDetails"))


def write_run_result(status: DataFrame, path: str) -> None:
    """Run-result JSON sink (A5)."""
    run_result(status).coalesce(1).write.mode("overwrite").json(path)


def collect_outputs(frames: Sequence[DataFrame], schema: T.StructType) -> DataFrame:
    """Stack per-batch outputs into one table with a declared schema.

    Columns are matched by name; types are widened by an explicit cast to the
    declared schema; a frame with other columns is an error.
    """
    names = [f.name for f in schema.fields]
    out = None
    for df in frames:
        if sorted(df.columns) != sorted(names):
            raise ValueError(f"inconsistent batch columns {df.columns} != {names}")
        d = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no batches")
    return out
