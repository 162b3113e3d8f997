"""Tick streams: de-duplication, bars, daily aggregates, per-symbol state, live detection."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom import config as cfg
from tickloom.functions.numeric import div, rnd
from tickloom.operators import ewm as E
from tickloom.operators.preprocess import keep_one
from tickloom.sources.market import bar_aggs, tick_order
from tickloom.sources.sample import event_symbol
from tickloom.streaming.runtime import drain, exists
from tickloom.streaming.versioned import Versioned

SYM = ["symbol"]


def tick_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int = 1) -> DataFrame:
    """File-source tick stream.  The event time is cast from timestamp_ntz, which a watermark does not accept."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
           .option("maxFilesPerTrigger", files_per_batch).parquet(folder))
    return raw.select(event_symbol().alias("symbol"), "event_id", "ts",
                      F.col("ts").cast("date").alias("date"), F.col("ts").cast("timestamp").alias("event_time"), "value")


def dedup_stream(ticks: DataFrame, keys: Sequence[str], delay: str = "2 days") -> DataFrame:
    """First arrival of each key; a repeat within the watermark is dropped, so a replayed day adds nothing."""
    return ticks.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(keys))


def bar_sink(base: str):
    """``foreachBatch`` writer of daily bars that survive late ticks and replays.

    A batch's ticks become partitions of their own, (day, batch), of a raw table, so writing it twice leaves it once.  The days it touches
    are then aggregated again from all their raw ticks (one per event_id) and replace exactly those days of the bars.  Only the folders of
    those days are opened or listed, however many days and batches are stored; nothing that is being replaced is read, no tick is too
    late, and no state grows with time.  Days that had raw ticks before this batch are noted as late.
    """
    raw, out, late = (os.path.join(base, n) for n in ("ticks", "table", "late"))
    schema = "symbol string, event_id bigint, ts timestamp_ntz, value double, date date, batch long"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        (batch.select("symbol", "event_id", "ts", "value", "date", F.lit(batch_id).alias("batch")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(raw))
        days = [r.date for r in batch.select("date").distinct().collect()]  # the days of one batch
        if not days:
            return
        touched = spark.read.schema(schema).option("basePath", raw).parquet(
            *[os.path.join(raw, f"date={'__HIVE_DEFAULT_PARTITION__' if d is None else d.isoformat()}") for d in days])
        (touched.where(F.col("batch") < batch_id).select("date").distinct().write.mode("overwrite").parquet(os.path.join(late, f"batch={batch_id}")))
        ticks = touched.dropDuplicates(["symbol", "date", "event_id"])
        bars = ticks.groupBy("symbol", "date").agg(*bar_aggs("value", tick_order(F.col("ts"), F.col("event_id"))))
        (bars.hint("rebalance", F.col("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("date").parquet(out))

    return write


def run_bars(ticks: DataFrame, base: str) -> DataFrame:
    """Drain a finite tick stream into a day-partitioned bar table and read it back."""
    drain(ticks.writeStream.option("checkpointLocation", os.path.join(base, "ck")).foreachBatch(bar_sink(base)).trigger(availableNow=True).start())
    schema = "symbol string, open double, high double, low double, close double, volume double, date date"
    return ticks.sparkSession.read.schema(schema).parquet(os.path.join(base, "table")).select(
        "symbol", "date", "open", "high", "low", "close", "volume")


def late_days(spark: SparkSession, base: str) -> DataFrame:
    """(batch, date): days of which a batch brought more ticks after they had been stored."""
    return spark.read.schema("date date, batch long").parquet(os.path.join(base, "late")).select("batch", "date")


def stored_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or no rows when nothing was written yet; any other failure is raised."""
    try:
        return spark.read.parquet(path).select(*like.columns)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return like.limit(0)


def upsert_sink(path: str, keys: Sequence[str] = ("symbol", "date"), day: str = "date"):
    """``foreachBatch`` writer that merges a batch into a day-partitioned table.

    A late or corrected row rewrites its own day only; replaying a batch after a failure gives the same table.  The old rows of the
    touched days are read from the path being replaced, so the merged days are first written to a side table of this batch; once that is
    complete, a replay continues from it and never merges with half-replaced days.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        side = f"{path.rstrip('/')}-merge-{batch_id}"
        if not exists(spark, f"{side}/_SUCCESS"):
            fresh = batch.withColumn("_new", F.lit(1))
            stored = stored_or_empty(spark, path, batch)
            old = stored.join(batch.select(day).distinct(), day, "left_semi").select(*batch.columns).withColumn("_new", F.lit(0))
            keep_one(old.unionByName(fresh), list(keys), ["_new"], last=True).drop("_new").write.mode("overwrite").parquet(side)
        (spark.read.schema(batch.schema).parquet(side).hint("rebalance", F.col(day)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path))

    return write


def run_upsert(stream: DataFrame, base: str, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Drain a finite update-mode stream of keyed rows into a day-partitioned table and read it back."""
    path = os.path.join(base, "table")
    cols = stream.columns
    drain(stream.writeStream.outputMode("update").option("checkpointLocation", os.path.join(base, "ck"))
          .foreachBatch(upsert_sink(path, keys)).trigger(availableNow=True).start())
    return stream.sparkSession.read.parquet(path).select(*cols)


# --- state carried across days -----------------------------------------------------------------------------------------

_STATE = T.StructType([T.StructField("last_date", T.DateType()), T.StructField("ema", T.DoubleType()), T.StructField("n", T.LongType())])
_EMA_OUT = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()),
                         T.StructField("close", T.DoubleType()), T.StructField("ema", T.DoubleType()),
                         T.StructField("late", T.BooleanType())])


def ema_stream(bars: DataFrame, rows: int = cfg.SHORT_WINDOW) -> DataFrame:
    """EMA of each symbol's close with state (last date, last value, count) instead of a recomputation.

    Rows are ordered inside a micro-batch.  A row not newer than the stored date is emitted with ``late`` set and does
    not touch the state: its symbol's days go through :func:`tickloom.streaming.incremental.dirty_days`.  Python is called for each
    symbol of a batch; batches that touch most symbols go through :func:`run_ema`.
    """
    a = 2.0 / (rows + 1)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ema, n = state.get if state.exists else (None, None, 0)
        pdf = pd.concat(list(frames)).sort_values("date", ignore_index=True)
        out = []
        for day, close in zip(pdf["date"], pdf["close"]):
            late = last is not None and day <= last
            if not late:
                ema = close if ema is None else (1 - a) * ema + a * close
                last, n = day, n + 1
            out.append((key[0], day, close, None if late else ema, late))
        state.update((last, ema, n))
        yield pd.DataFrame(out, columns=["symbol", "date", "close", "ema", "late"])

    return bars.groupBy("symbol").applyInPandasWithState(step, _EMA_OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


EMA_STATE = "symbol string, last date, before double"


def ema_rows(batch: DataFrame, state: DataFrame, rows: int = cfg.SHORT_WINDOW) -> DataFrame:
    """The rows of a batch as :func:`ema_stream` has them, for all symbols at once; a row without a close has no average.

    Window sums start from the batch's first close x1.  A state y0 in its place adds ``q^i (y0 - x1)`` to the i-th row.
    """
    c, q = F.col, 1.0 - 2.0 / (rows + 1)
    again = F.row_number().over(Window.partitionBy("symbol", "date").orderBy("close")) > 1
    own = batch.select("symbol", "date", "close").join(state, "symbol", "left")
    own = own.withColumn("late", F.coalesce(c("date") <= c("last"), F.lit(False)) | again)
    keys, mean = ["symbol", "_step"], [E.span("_y", "close", rows, None)]
    d = E.number_rows(own.withColumn("_step", ~c("late") & c("close").isNotNull()), keys, "date", E.block_rows(mean))
    d = E.with_ewm(d, keys, mean, nulls=False)
    x1 = F.first("close").over(Window.partitionBy(*keys).orderBy("date"))
    shift = F.coalesce(F.pow(F.lit(q), c("_rn")) * (c("before") - x1), F.lit(0.0))
    return d.select("symbol", "date", "close", F.when(c("_step"), c("_y") + shift).alias("ema"), "late")


def ema_sink(base: str, rows: int = cfg.SHORT_WINDOW, every: int = 16):
    """``foreachBatch`` writer of averages; the state before a batch is read by version, so a batch written twice gives the same rows."""
    states = Versioned(os.path.join(base, "states"), EMA_STATE, ("symbol",), every)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, out = batch.sparkSession, os.path.join(base, "out", f"batch={batch_id}")
        ema_rows(batch, states.before(spark, batch_id), rows).write.mode("overwrite").parquet(out)
        newest = F.max(F.when(F.col("ema").isNotNull(), F.struct("date", "ema"))).alias("s")
        new = spark.read.schema(_EMA_OUT).parquet(out).groupBy("symbol").agg(newest).where("s IS NOT NULL")
        states.write(new.select("symbol", F.col("s.date").alias("last"), F.col("s.ema").alias("before")), batch_id)

    return write


def run_ema(bars: DataFrame, base: str, rows: int = cfg.SHORT_WINDOW, every: int = 16) -> DataFrame:
    """Drain a finite stream of (symbol, date, close) and read the averages back."""
    drain(bars.writeStream.option("checkpointLocation", os.path.join(base, "ck")).foreachBatch(ema_sink(base, rows, every))
          .trigger(availableNow=True).start())
    return bars.sparkSession.read.schema(_EMA_OUT).parquet(os.path.join(base, "out")).select(*_EMA_OUT.names)


def symbol_baseline(prices: DataFrame) -> DataFrame:
    """Stored per-symbol statistics that live rows are held against."""
    return prices.groupBy("symbol").agg(F.count("pct_change").alias("hist_n"), F.avg("pct_change").alias("hist_mean"),
                                        F.stddev_samp("pct_change").alias("hist_std"))


def live_unusual(stream: DataFrame, baseline: DataFrame) -> DataFrame:
    """Arriving price rows that are unusual against the stored baseline: a stream-static join."""
    z = rnd(div(F.col("pct_change") - F.col("hist_mean"), F.col("hist_std")), 4)
    return (stream.join(baseline, "symbol").withColumn("z", z)
            .where((F.col("hist_n") >= cfg.MIN_SYMBOL_ROWS + 2) & (F.abs("z") >= cfg.UNUSUAL_Z))
            .select("symbol", "date", "pct_change", "z"))
