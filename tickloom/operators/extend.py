"""Histories put together from bars and daily snapshots, and key-set operations between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.numeric import rnd
from tickloom.operators import daily as D
from tickloom.operators.preprocess import business_grid
from tickloom.sources.market import prices_from_bars

PRICE_COLS = ["universe", "date", "symbol", "company_name", "price", "change", "pct_change"]


def company_names(prices: DataFrame) -> DataFrame:
    return prices.groupBy("symbol").agg(F.min_by("company_name", "date").alias("company_name"))


def days_not_in(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``df`` on dates that ``other`` does not have."""
    return df.join(other.select("date").distinct(), "date", "left_anti").select(*df.columns)


def keys_not_in(df: DataFrame, other: DataFrame, keys=("date", "symbol")) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti").select(*df.columns)


def missing_days(bars: DataFrame) -> DataFrame:
    """Business days inside each symbol's span that have no bar."""
    return business_grid(bars).join(bars.select("symbol", "date"), ["symbol", "date"], "left_anti")


def missing_market_days(prices: DataFrame, look_back: int = 30) -> DataFrame:
    """Business days of the last ``look_back`` days, up to the newest stored day, without any row."""
    span = prices.agg(F.max("date").alias("b"), F.min("date").alias("a")).select(
        F.explode(F.sequence(F.greatest("a", F.date_sub("b", look_back)), F.col("b"))).alias("date"))
    return span.where(F.weekday("date") < 5).join(prices.select("date").distinct(), "date", "left_anti")


def bars_before_snapshots(bars: DataFrame, prices: DataFrame) -> DataFrame:
    """Price rows from bars on days without a snapshot, for snapshot symbols.

    Returns are taken on the full bars first, so none spans a removed day.
    """
    known = bars.join(prices.select("symbol").distinct(), "symbol", "left_semi")
    rows = days_not_in(prices_from_bars(known).drop("company_name"), prices)
    return rows.join(company_names(prices), "symbol", "left").select(
        "universe", "date", "symbol", F.coalesce("company_name", F.lit("")).alias("company_name"),
        *[rnd(F.col(c), 4).alias(c) for c in ("price", "change", "pct_change")])


def extended_prices(bars: DataFrame, prices: DataFrame) -> DataFrame:
    return bars_before_snapshots(bars, prices).unionByName(prices.select(*PRICE_COLS))


def extended_hist(bars: DataFrame, prices: DataFrame) -> DataFrame:
    """Daily metrics from bars where there is no snapshot, then snapshots; one rolling pass over the union."""
    scraped = D.daily_breadth(prices).withColumn("source", F.lit("scraped"))
    prior = days_not_in(D.bar_daily_aggregates(bars), prices).withColumn("source", F.lit("bars"))
    return D.rolling_intelligence(prior.unionByName(scraped))
