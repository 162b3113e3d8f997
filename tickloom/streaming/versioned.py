"""Keyed tables that a stream rewrites batch by batch, read by version.

Each batch writes the rows it changed into a folder of its own, named by the batch, so a batch that is written twice leaves the same table
and nothing that is being read is ever replaced.  Every ``every`` batches the folder holds all rows instead; a reader needs the folders
from the last such one on, whose names follow from the number alone, so neither the number of files read nor any listing grows with time.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


@dataclass(frozen=True)
class Versioned:
    path: str
    schema: str
    keys: tuple[str, ...]
    every: int = 16

    def folder(self, batch: int) -> str:
        return os.path.join(self.path, f"batch={batch}")

    def before(self, spark: SparkSession, batch: int) -> DataFrame:
        """The newest row of every key as it was before ``batch``."""
        if batch <= 0:
            return spark.createDataFrame([], self.schema)
        start = (batch - 1) // self.every * self.every
        rows = None
        for k in range(start, batch):
            one = spark.read.schema(self.schema).parquet(self.folder(k)).withColumn("_batch", F.lit(k))
            rows = one if rows is None else rows.unionByName(one)
        newest = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("_batch")))
        return rows.withColumn("_new", newest).where(F.col("_new") == 1).drop("_batch", "_new")

    def write(self, changed: DataFrame, batch: int) -> None:
        """Take the changed rows of ``batch``, at most one per key."""
        if batch % self.every == 0:
            kept = self.before(changed.sparkSession, batch).join(changed, list(self.keys), "left_anti")
            changed = changed.unionByName(kept.select(*changed.columns))
        changed.write.mode("overwrite").parquet(self.folder(batch))


def rows_of_keys(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows whose keys a batch touches."""
    return table.join(batch.select(*keys).distinct(), list(keys), "left_semi")
