"""Exact removal of repeats from a stream, however late they come.

A watermark forgets keys.  Here the keys seen so far are a table bucketed by their hash: a batch is dealt into the same buckets, anti-joined
to the table in place (the table is not shuffled), and its new keys are appended as the batch's own partition.  Writing a batch twice
leaves the same keys and rows, since a batch is held only against the partitions of earlier ones.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.streaming.runtime import drain


class SeenKeys:
    """The table of keys seen so far, below ``base`` in the shared folder, under a name of the catalogue."""

    def __init__(self, spark: SparkSession, base: str, schema: str, buckets: int, name: str | None = None):
        self.spark, self.name = spark, name or f"seen_{uuid.uuid4().hex}"
        self.keys = spark.createDataFrame([], schema).columns
        of = ", ".join(f"`{k}`" for k in self.keys)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}, batch BIGINT) USING parquet PARTITIONED BY (batch) "
                  f"CLUSTERED BY ({of}) INTO {buckets} BUCKETS LOCATION '{os.path.join(base, 'seen')}'")

    def unseen(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The rows of ``batch`` whose keys no earlier batch had, one for each key.  A key with a missing part is a key like any other."""
        seen = self.spark.table(self.name).where(F.col("batch") < batch_id)
        same = [batch[k].eqNullSafe(seen[k]) for k in self.keys]
        return batch.dropDuplicates(self.keys).join(seen, same, "left_anti")

    def add(self, fresh: DataFrame, batch_id: int) -> None:
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = {batch_id})")
        fresh.select(*self.keys, F.lit(batch_id).cast("long").alias("batch")).write.mode("append").insertInto(self.name)


def exact_sink(seen: SeenKeys, out: str):
    """``foreachBatch`` writer of first arrivals: the rows into a folder of the batch, then their keys into the table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        path = os.path.join(out, f"batch={batch_id}")
        seen.unseen(batch, batch_id).write.mode("overwrite").parquet(path)
        seen.add(batch.sparkSession.read.schema(batch.schema).parquet(path), batch_id)

    return write


def run_exact(stream: DataFrame, base: str, keys: Sequence[str], buckets: int = 16) -> DataFrame:
    """Drain a finite stream and return its first arrivals; the key table stays for the next run of the same ``base``."""
    spark, fields = stream.sparkSession, {f.name: f for f in stream.schema.fields}
    name = "seen_" + uuid.uuid5(uuid.NAMESPACE_URL, base).hex
    seen = SeenKeys(spark, base, ", ".join(f"`{k}` {fields[k].dataType.simpleString()}" for k in keys), buckets, name)
    out = os.path.join(base, "first")
    drain(stream.writeStream.option("checkpointLocation", os.path.join(base, "ck")).foreachBatch(exact_sink(seen, out))
          .trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)
