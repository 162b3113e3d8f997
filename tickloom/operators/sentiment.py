"""Headline scoring and daily sentiment aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tickloom import config as cfg
from tickloom.functions import ladders
from tickloom.functions.numeric import div, rnd
from tickloom.functions.windows import trailing, mean

TOKEN_SPLIT = "[^a-zà-ÿ]+"


def lexicon_score(text: Column, lexicon: dict[str, float]) -> Column:
    """Mean weight of the matched tokens, 0 when none match; a per-row expression for small lexicons."""
    weights = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in kv])
    tokens = F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t.isin(*lexicon))
    total = F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + F.element_at(weights, t))
    return rnd(F.coalesce(div(total, F.size(tokens)), F.lit(0.0)), 4)


def lexicon_table_score(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, score) against a ``token, weight`` table of any size; the join side is chosen by Spark from its size.

    A small table should have a size that Spark knows, as stored tables and literals have.  Rows sent from the driver have none, and then
    the texts are shuffled and sorted by token, where a frequent one makes the largest task grow with the input.
    """
    tokens = df.select(key, F.explode(F.split(F.lower(F.col(text)), TOKEN_SPLIT)).alias("token"))
    hit = tokens.join(lexicon, "token").groupBy(key).agg(F.avg("weight").alias("score"))
    return df.select(key).join(hit, key, "left").select(key, rnd(F.coalesce("score", F.lit(0.0)), 4).alias("score"))


def model_score(load: Callable[[], Callable[[list[str]], list[float]]], fallback=None, batch: int = 16):
    """Arrow iterator UDF around a user model: loaded once per task, called in batches, optional fallback scorer."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            texts, out = s.fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                chunk = texts[i:i + batch]
                try:
                    out += list(model(chunk))
                except Exception:
                    if fallback is None:
                        raise
                    out += list(fallback(chunk))
            yield pd.Series(out, dtype="float64").round(4)

    return score


def _order_key(order: Sequence[str]) -> Column:
    """One or two integral columns (the second from 0 to 10^10) as one exact number, which a hash aggregate can keep."""
    if len(order) > 2:
        raise ValueError("at most two order columns")
    wide = [F.col(c).cast(T.DecimalType(19, 0)) for c in order]
    key = wide[0] if len(wide) == 1 else wide[0] * F.lit(Decimal(10) ** 10) + wide[1]
    return key.cast(T.DecimalType(38, 0))


def headline_sentiment(scored: DataFrame, order: Sequence[str] = ("doc_id", "line")) -> DataFrame:
    """Per (symbol, date): mean score, label, count and the headline nearest the mean (first on a tie).

    Headlines become one row per distinct score of a symbol's day in a hash aggregate, map-side, so each is scored once and a symbol with
    most of the news is never gathered.  The chosen headline's text is fetched by its key, which names one row.
    """
    keys, c = ["symbol", "date"], F.col
    each = scored.select(*keys, "score", _order_key(order).alias("_key")).groupBy(*keys, "score").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_key"))
    known = F.when(c("score").isNotNull(), c("_n"))
    total = each.groupBy(*keys).agg(F.sum(known).alias("_known"), F.sum(c("score") * known).alias("_sum"))
    means = total.select(*keys, div(c("_sum"), c("_known")).alias("_mean"), F.coalesce("_known", F.lit(0)).alias("headlines_used"))
    near = rnd(F.abs(c("score") - c("_mean")), 9)
    best = each.join(means, keys).groupBy(*keys, "_mean", "headlines_used").agg(
        F.min(F.struct(near.isNull().alias("none"), near.alias("near"), c("_key").alias("key"))).alias("_best")).select(
            *keys, "_mean", "headlines_used", c("_best.key").alias("_key"))
    texts = scored.select(*keys, _order_key(order).alias("_key"), "headline")
    return (
        best.join(texts, [*keys, "_key"]).groupBy(*keys, "_mean", "headlines_used").agg(F.min("headline").alias("top_headline"))
        .select("date", "symbol", rnd(c("_mean"), 4).alias("sentiment_score"),
                ladders.sentiment_label(rnd(c("_mean"), 9)).alias("sentiment_label"), "headlines_used", "top_headline")
    )


def cover_symbols(sentiment: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per requested (date, symbol); a pair without news is labelled "No Data"."""
    return keys.join(sentiment, ["date", "symbol"], "left").select(
        "date", "symbol", "sentiment_score", F.coalesce("sentiment_label", F.lit("No Data")).alias("sentiment_label"),
        F.coalesce("headlines_used", F.lit(0)).alias("headlines_used"),
        F.coalesce("top_headline", F.lit("No headlines available")).alias("top_headline"))


def daily_sentiment(sentiment: DataFrame) -> DataFrame:
    daily = (sentiment.where(F.col("sentiment_score").isNotNull()).groupBy("date")
             .agg(F.avg("sentiment_score").alias("avg_score")))
    return (daily.withColumn("_u", F.lit("all"))
            .select("date", "avg_score", mean(F.col("avg_score"), trailing(["_u"], cfg.SHORT_WINDOW)).alias("rolling_7d")))


def vix_score(vix: Column) -> Column:
    return rnd(-F.tanh((vix - 20) / 10), 4)


def extended_sentiment(daily: DataFrame, vix: DataFrame) -> DataFrame:
    """Scored days plus fear-index days that have no score; the 7-day mean runs over the union."""
    nlp = daily.select("date", "avg_score", F.lit("nlp").alias("source"))
    proxy = vix.select("date", vix_score(F.col("vix")).alias("avg_score"), F.lit("vix").alias("source"))
    both = proxy.join(nlp.select("date"), "date", "left_anti").unionByName(nlp).withColumn("_u", F.lit("all"))
    return both.select("date", "avg_score", "source",
                       rnd(mean(F.col("avg_score"), trailing(["_u"], cfg.SHORT_WINDOW)), 4).alias("rolling_7d"))


def sentiment_breadth(sentiment: DataFrame, by: list[str] = ()) -> DataFrame:
    """Label counts, shares, mean score and regime vote, overall or per ``by``."""
    label = F.col("sentiment_label")
    n = F.col("n_total")
    counts = sentiment.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(label == "Bullish").alias("n_bullish"),
        F.count_if(label == "Bearish").alias("n_bearish"), F.count_if(label == "Neutral").alias("n_neutral"),
        F.count_if(label == "No Data").alias("n_no_data"),
        F.coalesce(F.avg("sentiment_score"), F.lit(0.0)).alias("_mean"))
    bull, bear, neut = F.col("n_bullish"), F.col("n_bearish"), F.col("n_neutral")
    m = rnd(F.col("_mean"), 9)
    regime = ladders.ladder([((bull > bear) & (bull > neut), "Risk-On"), ((bear > bull) & (bear > neut), "Risk-Off"),
                             (m >= cfg.BULLISH_SCORE, "Cautiously Bullish"),
                             (m <= cfg.BEARISH_SCORE, "Cautiously Bearish")], "Mixed")

    def pct(c):
        return rnd(F.coalesce(div(c, n), F.lit(0.0)) * 100, 1)

    return counts.select(
        *by, "n_total", "n_bullish", "n_bearish", "n_neutral", "n_no_data", pct(bull).alias("pct_bullish"),
        pct(bear).alias("pct_bearish"), pct(neut).alias("pct_neutral"), pct(F.col("n_no_data")).alias("pct_no_data"),
        rnd(F.col("_mean"), 4).alias("mean_score"),
        F.when(n == 0, F.lit("Neutral")).otherwise(regime).alias("regime"))


def top_sentiment(sentiment: DataFrame, label: str, n: int = 5) -> DataFrame:
    """The ``n`` strongest rows of one label, ties by date then symbol."""
    score = F.col("sentiment_score")
    order = score.desc() if label == "Bullish" else score.asc()
    return sentiment.where(F.col("sentiment_label") == label).orderBy(order, "date", "symbol").limit(n)


def news_listing(sentiment: DataFrame) -> DataFrame:
    """A day's headlines in reading order: ``rank`` 1 has the highest score, rows without one come last, ties go to the symbol."""
    day = Window.partitionBy("date").orderBy(F.col("sentiment_score").desc_nulls_last(), "symbol")
    return sentiment.select("date", F.row_number().over(day).alias("rank"), "symbol", "sentiment_score", "sentiment_label", "top_headline")


def with_asof_sentiment(prices: DataFrame, sentiment: DataFrame) -> DataFrame:
    """``prices`` with ``_last``: the symbol's latest sentiment on or before the row's date, as a struct.

    The tables are put together and each price row takes the last sentiment of its symbol, so all price columns go along and nothing is
    joined back.
    """
    s = sentiment.select("symbol", "date", F.struct("sentiment_score", "sentiment_label", F.col("date").alias("sent_date"))
                         .alias("_s"), F.lit(0).alias("_kind"))
    p = prices.select("*", F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), F.lit(1).alias("_kind"))
    w = Window.partitionBy("symbol").orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(s, allowMissingColumns=True)
    return both.withColumn("_last", F.last("_s", ignorenulls=True).over(w)).where(F.col("_kind") == 1).select(*prices.columns, "_last")


def asof_sentiment(prices: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Latest sentiment on or before each price date, per symbol."""
    return with_asof_sentiment(prices.select("date", "symbol", "price", "pct_change"), sentiment).select(
        "date", "symbol", "price", "pct_change", "_last.sentiment_score", "_last.sentiment_label", "_last.sent_date")
