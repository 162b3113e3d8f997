"""Incremental batch maintenance of per-day tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.operators import daily as D


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-free content hash per date."""
    cols = sorted(df.columns)
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h"))


def dirty_days(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Dates whose rows differ from what was aggregated before: new, changed or vanished, newer or older than the stored days."""
    a, b = fingerprint(current), fingerprint(stored).select("date", F.col("n").alias("_n"), F.col("h").alias("_h"))
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("h").eqNullSafe(F.col("_h"))
    return a.join(b, "date", "full").where(~same).select("date")


def refresh_hist(current: DataFrame, stored_prices: DataFrame, stored_daily: DataFrame) -> DataFrame:
    """Re-aggregate dirty days only, keep the rest, and run the rolling pass on the day table."""
    dirty = dirty_days(current, stored_prices)
    fresh = D.daily_breadth(current.join(dirty, "date", "left_semi").select(*current.columns))
    kept = stored_daily.join(dirty, "date", "left_anti").select(*fresh.columns)
    return D.rolling_intelligence(kept.unionByName(fresh))
