"""Stored tables: typed reads and idempotent writes in plain parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom.operators.preprocess import keep_one
from tickloom.schema import conform, empty


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored table in canonical form; an empty table of that schema when nothing is stored yet."""
    try:
        return conform(spark.read.option("mergeSchema", "true").parquet(path), schema, keep_extra=True)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return empty(spark, schema)


def is_readable(spark: SparkSession, path: str) -> tuple[bool, str]:
    try:
        return (True, "") if not spark.read.parquet(path).isEmpty() else (False, "table is empty")
    except Exception as e:
        return False, f"cannot read: {type(e).__name__}"


def write_table(df: DataFrame, path: str, schema: T.StructType | None = None, keys: Sequence[str] = (),
                order: Sequence[str] = (), partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Cast, drop repeated keys (first in ``order`` wins) and write.

    With ``partition_by`` only the partitions present in ``df`` are replaced, so a late day rewrites that day alone.
    Rows are clustered by the partition columns first, which bounds the number of files per partition.
    """
    if keys:
        df = keep_one(df, list(keys), list(order or [c for c in df.columns if c not in keys]))
    if schema is not None:
        df = conform(df, schema)
    if partition_by:
        # The rebalance hint lets adaptive execution split an oversized partition value over several tasks.
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
        df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def symbol_json(features: DataFrame, columns: Sequence[str], min_rows: int = 20) -> DataFrame:
    """Per symbol, its chart columns as one JSON text of date-ordered records (one record per day)."""
    have = features.where(F.col("close").isNotNull())
    rows = F.sort_array(F.collect_list(F.struct(F.col("date"), *[c for c in columns if c != "date"])))
    return (have.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), rows.alias("_r")).where(F.col("n_rows") >= min_rows)
            .select("symbol", "n_rows", F.to_json("_r").alias("json")))
