"""Canonical views over the TPC-H style sample tables (see FIXTURES.md)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.numeric import div, rnd
from tickloom.functions.windows import whole
from tickloom.operators.sentiment import lexicon_score
from tickloom.sources.market import bars_from_ticks, prices_from_bars, tick_order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def event_symbol(user_id: str = "user_id") -> Column:
    """``U`` and the id with at least four digits; longer ids keep all of theirs."""
    text = F.col(user_id).cast("string")
    return F.concat(F.lit("U"), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        event_symbol().alias("symbol"), F.col("ts").cast("date").alias("date"), "ts", "event_id", "value", "event_type")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(event_ticks(spark, sf_dir), "value", tick_order(F.col("ts"), F.col("event_id")))


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices_from_bars(event_bars(spark, sf_dir))


def trade_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return (
        li.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"),
                F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
              F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("symbol"),
                F.trunc(F.col("l_shipdate").cast("date"), "week").alias("date"),
                div(F.col("l_extendedprice"), F.col("l_quantity")).alias("trade_price"),
                "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))


def trade_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "trade_price")
    vwap = rnd(div(F.sum("l_extendedprice"), F.sum("l_quantity")), 6).alias("vwap")
    return bars_from_ticks(trade_ticks(spark, sf_dir), "trade_price", order, F.col("l_quantity"), [vwap])


def trade_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices_from_bars(trade_bars(spark, sf_dir), "vwap")


# Token weights for the sample prose, which is invented and matches no real lexicon.
SAMPLE_LEXICON = {
    "the": 0.4, "and": 0.3, "by": -0.6, "of": -0.2, "that": 0.5, "with": -0.4, "for": 0.6, "is": -0.3,
    "le": 0.4, "la": -0.5, "des": 0.3, "un": -0.2, "du": 0.6, "qui": -0.4, "pour": 0.5, "par": -0.3,
    "der": 0.4, "die": -0.5, "und": 0.3, "nicht": -0.7, "el": 0.4, "de": -0.3, "que": 0.2, "los": -0.4,
}


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, doc_id, line, headline, score): one scored headline per line of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("symbol"))
    week = F.expr("date_add(DATE'1995-01-02', CAST(7 * ((doc_id DIV 25) % 357) AS INT))")
    lines = docs.select("doc_id", (F.col("doc_id") % 25).cast("int").alias("n_nationkey"), week.alias("date"),
                        F.posexplode(F.split("text", "\n")).alias("line", "headline"))
    return (
        lines.withColumn("headline", F.trim("headline"))
        .where(F.length("headline") > 3)
        .join(nation, "n_nationkey")
        .select("symbol", "date", "doc_id", "line", "headline", lexicon_score(F.col("headline"), SAMPLE_LEXICON).alias("score"))
    )


def vix_like(hist: DataFrame) -> DataFrame:
    """20 + 5 x z-score of the day's volatility: a stand-in fear index for the tanh mapping."""
    w = whole(["universe"])
    z = div(F.col("volatility") - F.avg("volatility").over(w), F.stddev_samp("volatility").over(w))
    return hist.select("universe", "date", (20 + 5 * z).alias("vix")).where(F.col("vix").isNotNull())
