"""From ticks and bars to the canonical price table.  Every step is a partial aggregate or a per-symbol window."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.functions.numeric import div
from tickloom.functions.windows import ordered


def tick_order(ts: Column, tie: Column) -> Column:
    """(ts, tie) as one exact number, for a timestamp_ntz and a non-negative bigint.

    ``min_by`` on a fixed-width key runs as a hash aggregate; on a struct it would sort every tick first.
    """
    # Built from the fields, so no session time zone and no daylight-saving hole is involved.
    minutes = (F.unix_date(ts.cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts))
    micros = minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (micros.cast(T.DecimalType(18, 0)) * F.lit(Decimal(10) ** 19) + tie.cast(T.DecimalType(19, 0))).cast(T.DecimalType(38, 0))


def bar_aggs(value: str, order: Column, volume: Column | None = None) -> list[Column]:
    """Open/high/low/close/volume aggregates; merges map-side, so a hot symbol costs one row per task and day."""
    return [
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, order).alias("close"),
        (F.count(F.lit(1)) if volume is None else F.sum(volume)).cast("double").alias("volume"),
    ]


def bars_from_ticks(ticks: DataFrame, value: str, order: Column, volume: Column | None = None,
                    extra: list[Column] = ()) -> DataFrame:
    """Daily (or any ``date`` grain) bars from rows carrying ``symbol`` and ``date``."""
    return ticks.groupBy("symbol", "date").agg(*bar_aggs(value, order, volume), *extra)


def prices_from_bars(bars: DataFrame, price: str = "close", universe: str = "all") -> DataFrame:
    """One row per (date, symbol) with change against the symbol's previous bar; the first bar is dropped."""
    prev = F.lag(price).over(ordered(["symbol"]))
    return (
        bars.withColumn("_prev", prev).where(F.col("_prev").isNotNull())
        .select(F.lit(universe).alias("universe"), "date", "symbol", F.col("symbol").alias("company_name"),
                F.col(price).alias("price"), (F.col(price) - F.col("_prev")).alias("change"),
                (div(F.col(price) - F.col("_prev"), F.col("_prev")) * 100).alias("pct_change"))
    )
