"""Where streaming state and output live."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the folder that the session names for checkpoints, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        raise ValueError("spark.checkpoint.dir is not set: streams and stored tables need a folder that all executors share")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block; the caller's own comes back after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drain(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query and surface its error."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def append_all(stream: DataFrame, base: str, schema=None) -> DataFrame:
    """Run a finite append stream to the end into parquet and return the written table."""
    out = os.path.join(base, "out")
    drain(stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", os.path.join(base, "ck"))
          .option("path", out).trigger(availableNow=True).start())
    return stream.sparkSession.read.schema(schema or stream.schema).parquet(out)
