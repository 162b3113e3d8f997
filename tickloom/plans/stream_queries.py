"""Streaming queries: each drains the events file through Structured Streaming and returns the written table."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from tickloom.operators import daily as D, indicators as I
from tickloom.plans.detector_queries import gap_sql, signal_sql
from tickloom.plans.registry import query
from tickloom.plans.sqlviews import HIST_COLS, ROLL_COLS, SYMBOL, ema_sql, r, with_
from tickloom.plans.symbols import atr_sql, macd_sql, rsi_sql
from tickloom.sources import sample as S
from tickloom.sources.market import prices_from_bars
from tickloom.streaming import detectors as LD, exact as EX, incremental as INC, indicator_state as IS, moments as MO, ticks as TK
from tickloom.streaming.runtime import append_all, work_dir


# Deliveries of the events: days in turn, and a few ticks of even days long after their day.
SLICE = "CASE WHEN event_id % 50 = 7 AND day(ts) % 2 = 0 THEN 4 ELSE day(ts) % 4 END"
SLICES = 5


def delivered(spark, sf, base: str):
    """The events as one file for each of several deliveries, read one per micro-batch."""
    path = os.path.join(base, "in")
    S.table(spark, sf, "events").withColumn("slice", F.expr(SLICE)).repartition(SLICES, "slice").write.partitionBy("slice").parquet(path)
    return TK.tick_stream(spark, path, "*.parquet")


def bars(spark, sf):
    base = work_dir(spark, "bars")
    return TK.run_bars(delivered(spark, sf, base), base)


def late(spark, sf):
    base = work_dir(spark, "late")
    TK.run_bars(delivered(spark, sf, base), base)
    return TK.late_days(spark, base).select("date").distinct()


query("stream_bars", with_("event_bars", "SELECT * FROM event_bars"))(bars)
query("stream_late_days", f"""
    SELECT date FROM (SELECT DISTINCT CAST(ts AS DATE) AS date, {SLICE} AS slice FROM events) GROUP BY date HAVING count(*) > 1""")(late)
query("stream_daily_aggregates", with_("event_hist", f"SELECT {HIST_COLS} FROM event_hist"))(
    lambda s, d: D.daily_breadth(prices_from_bars(bars(s, d))).drop("universe"))


def replayed(spark, sf):
    """The events twice over (a replayed delivery): the second copy must add nothing."""
    t = TK.tick_stream(spark, sf)
    both = t.unionByName(TK.tick_stream(spark, sf))
    return append_all(TK.dedup_stream(both, ["event_id"]).select("symbol", "event_id", "date", "value"), work_dir(spark, "dedup"))


query("stream_dedup", f"""
    SELECT {SYMBOL} AS symbol, event_id, CAST(ts AS DATE) AS date, value FROM events""")(replayed)


WEEKS, FILES = 5, 2


def ema(spark, sf):
    """Bars arrive week by week, one micro-batch each; the state goes from batch to batch."""
    week = F.least(F.lit(WEEKS - 1), F.floor((F.dayofmonth("date") - 1) / 7)).cast("int")
    b = S.event_bars(spark, sf).select("symbol", "date", "close", week.alias("b"))
    out = TK.run_ema(in_batches(b, WEEKS, "ema"), work_dir(spark, "ema"), every=3)
    return out.select("symbol", "date", I.rnd(F.col("ema"), 4).alias("ema"), "late")


query("stream_ema", with_("event_bars", f"""
    SELECT symbol, date, {r(ema_sql('close', 7, 'symbol'), 4)} AS ema, false AS late FROM event_bars"""))(ema)

DAY = dt.date(2024, 1, 25)


def detector(spark, sf):
    """Rows from DAY on arrive as a stream and meet the baseline of the days before."""
    path = os.path.join(work_dir(spark, "live"), "prices")
    p = S.event_prices(spark, sf).select("symbol", "date", "pct_change")
    p.where(F.col("date") >= F.lit(DAY)).write.parquet(path)
    base = TK.symbol_baseline(p.where(F.col("date") < F.lit(DAY)))
    src = spark.readStream.schema("symbol string, date date, pct_change double").parquet(path)
    return append_all(TK.live_unusual(src, base), work_dir(spark, "live"))


query("stream_detector", with_("event_prices", f"""
    SELECT symbol, date, pct_change, {r('(pct_change - m) / nullif(sd, 0)', 4)} AS z FROM event_prices JOIN (
        SELECT symbol, count(pct_change) AS n, avg(pct_change) AS m, stddev_samp(pct_change) AS sd FROM event_prices
        WHERE date < DATE '{DAY}' GROUP BY symbol) USING (symbol)
    WHERE date >= DATE '{DAY}' AND n >= 5 AND abs({r('(pct_change - m) / nullif(sd, 0)', 4)}) >= 2.0"""))(detector)


def refreshed(spark, sf):
    """Stored days lack the newest week and hold a wrong older day; only those days are aggregated again."""
    now = S.event_prices(spark, sf)
    was = now.where((F.col("date") < F.lit(DAY)) & ((F.col("date") != F.lit(dt.date(2024, 1, 9))) | (F.col("symbol") > "U0005")))
    return INC.refresh_hist(now, was, D.daily_breadth(was)).select("date", "avg_pct", *[c.strip() for c in ROLL_COLS.split(",")])


query("incremental_refresh", with_("event_roll", f"SELECT date, avg_pct, {ROLL_COLS} FROM event_roll"))(refreshed)


def in_batches(df, batches: int, name: str, files: int = FILES):
    """A stream of ``df``, one batch after the other by its column ``b`` (0 to ``batches`` - 1)."""
    spark, base, kept = df.sparkSession, work_dir(df.sparkSession, name), df.drop("b").schema
    path, once = os.path.join(base, "in"), os.path.join(base, "once")
    df.write.partitionBy("b").parquet(once)  # computed once, not once per batch
    all_batches = spark.read.schema(df.schema).parquet(once)
    for k in range(batches):
        all_batches.where(F.col("b") == k).select(*kept.names).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(kept).option("maxFilesPerTrigger", files).parquet(path)


def moments(spark, sf):
    """Price rows in five batches: days in turn, and a quarter of the symbols' even days after all others."""
    late = (F.dayofmonth("date") % 2 == 0) & (F.pmod(F.crc32(F.col("symbol").cast("binary")), F.lit(4)) == 1)
    p = S.event_prices(spark, sf).select("universe", "symbol", "date", "change", "pct_change").withColumn(
        "b", F.when(late, F.lit(4)).otherwise(F.dayofmonth("date") % 4))
    # Every third batch writes all days, so that this way of storing is gone through too.
    return MO.run_daily(in_batches(p, 5, "moments"), work_dir(spark, "moments"), every=3).drop("universe")


query("stream_daily_moments", with_("event_hist", f"SELECT {HIST_COLS} FROM event_hist"))(moments)


STATE_FROM = dt.date(2024, 1, 8)


def indicator_updates(spark, sf):
    """Bars before STATE_FROM are stored and give the first state; later ones come in five deliveries, the 10th after the 19th."""
    day = F.dayofmonth("date")
    b = F.when(day == 10, 2).when(day <= 13, 0).when(day <= 19, 1).when(day <= 25, 3).otherwise(4)
    every = S.event_bars(spark, sf).select("symbol", "date", "high", "low", "close")
    new = every.where(F.col("date") >= F.lit(STATE_FROM)).withColumn("b", b)
    first = IS.initial_state(every.where(F.col("date") < F.lit(STATE_FROM)), tail=12)
    return IS.run_indicators_by_batch(in_batches(new, 5, "state"), work_dir(spark, "state"), first, tail=12, every=3)


# Under 63 returns every symbol has the standard window sizes.
query("stream_indicators", with_("event_bars", f"""
    SELECT m.*, x.rsi AS rsi_14, a.atr AS atr_14, false AS late
    FROM ({macd_sql(12, 26, 9, 'event_bars')}) m LEFT JOIN ({rsi_sql(14, 'event_bars')}) x USING (symbol, date)
    LEFT JOIN ({atr_sql(14, 'event_bars')}) a USING (symbol, date) WHERE date >= DATE '{STATE_FROM}'"""))(indicator_updates)


def live(spark, sf):
    """Five batches of whole days; each is judged against the baselines that the batches before it left."""
    p = S.event_prices(spark, sf).select("universe", "symbol", "date", "pct_change").withColumn(
        "b", F.least(F.lit(4), F.floor((F.dayofmonth("date") - 1) / 6)).cast("int"))
    return LD.run_live(in_batches(p, 5, "detectors"), work_dir(spark, "detectors"), every=2)


query("stream_detectors", with_("ee", f"""
    SELECT signal_type AS detector, symbol, date, direction AS grade, strength AS size, score, reason
    FROM ({signal_sql('volatility_spike', 'ee')} UNION ALL {signal_sql('unusual_mover', 'ee')})
    UNION ALL SELECT anomaly_type, symbol, date, severity, z_score, value, reason FROM ({gap_sql('ee')})"""))(live)


def exact(spark, sf):
    """Ticks in three batches; the third repeats a third of the first two, weeks later, and brings some late first arrivals."""
    t = S.table(spark, sf, "events").select(S.event_symbol().alias("symbol"), "event_id", "ts", F.col("ts").cast("date").alias("date"), "value")
    b = F.when(F.col("event_id") % 10 == 3, 2).when(F.dayofmonth("date") <= 15, 0).otherwise(1)
    once = t.withColumn("b", b)
    again = once.where((F.col("b") < 2) & (F.col("event_id") % 3 == 0)).withColumn("b", F.lit(2))
    return EX.run_exact(in_batches(once.unionByName(again), 3, "exact"), work_dir(spark, "exact"), ["event_id"]).drop("ts")


query("stream_dedup_exact", f"""
    SELECT {SYMBOL} AS symbol, event_id, CAST(ts AS DATE) AS date, value FROM events""")(exact)
