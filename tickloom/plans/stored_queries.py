"""Tables written and read back, the bundle of historical views, and headlines scored by a fitted model."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tickloom import schema as SC
from tickloom.functions.numeric import rnd
from tickloom.operators import daily as D, forecast as FC, scoring as SR, sentiment as SE
from tickloom.plans.detector_queries import fsql, sentiment
from tickloom.plans.feature_queries import trade_features
from tickloom.plans.market import trade_hist
from tickloom.plans.registry import SQL, query
from tickloom.plans.sqlviews import CTE, r, with_
from tickloom.sources import ingest as ING, sample as S, store
from tickloom.streaming.runtime import work_dir


def prices(spark, sf):
    """Stored with every row twice, then one corrected day is written over its own partition."""
    path, p = work_dir(spark, "prices"), S.event_prices(spark, sf)
    twice = p.withColumn("seq", F.lit(1)).unionByName(p.withColumns({"price": F.col("price") + 1, "seq": F.lit(2)}))
    store.write_table(twice, path, SC.PRICES, ["date", "symbol"], ["seq"], ["date"])
    day = p.where(F.col("date") == F.lit(dt.date(2024, 1, 10))).withColumn("price", F.col("price") * 2)
    store.write_table(day, path, SC.PRICES, ["date", "symbol"], ["price"], ["date"])
    return store.read_table(spark, path, SC.PRICES)


query("stored_prices", with_("event_prices", """
    SELECT date, symbol, company_name, CASE WHEN date = DATE '2024-01-10' THEN price * 2 ELSE price END AS price, change, pct_change
    FROM event_prices"""))(prices)


def back(df, name: str, schema, **how):
    """``df`` written as a stored table and read again."""
    path = work_dir(df.sparkSession, name)
    store.write_table(df, path, schema, **how)
    return store.read_table(df.sparkSession, path, schema)


query("stored_sentiment", with_("sentiment", """
    SELECT date, symbol, sentiment_score, sentiment_label, headlines_used::INTEGER AS headlines_used, top_headline FROM sentiment"""))(
    lambda s, d: back(sentiment(s, d), "sentiment", SC.SENTIMENT, keys=["date", "symbol"], order=["top_headline"]))

KEPT = ["rsi_14", "macd_hist", "price_vs_sma20", "returns_lag1"]


def features(spark, sf):
    """Written by year; a reader that asks for some years and columns opens those alone."""
    f = trade_features(spark, sf)
    path = work_dir(spark, "features")
    store.write_table(f.withColumn("year", F.year("date")), path, keys=["symbol", "date"], order=["close"], partition_by=["year"])
    return spark.read.parquet(path).where(F.col("year") >= 1999).select("symbol", "date", *KEPT)


query("stored_features", with_("feats", f"SELECT symbol, date, {', '.join(KEPT)} FROM feats WHERE year(date) >= 1999"))(features)
query("stored_macro", with_("trade_bars", """
    SELECT symbol AS series_alias, date, vwap AS value, 'V-' || symbol AS series_id FROM trade_bars WHERE vwap IS NOT NULL"""))(
    lambda s, d: back(ING.macro_series(S.trade_bars(s, d).select(
        F.col("symbol").alias("series_alias"), "date", F.col("vwap").alias("value"), F.concat(F.lit("V-"), "symbol").alias("series_id")),
        F.lit(dt.date(2001, 10, 30))).drop("recent"), "macro", SC.MACRO, keys=["series_alias", "date"], order=["value"]))
query("stored_forecasts", fsql("metrics bdays", "metrics", "metric", "value", "linear"))(
    lambda s, d: back(FC.forecast_metrics(trade_hist(s, d)).drop("universe"), "forecasts", SC.FORECASTS))
query("forecast_of_metric", f"SELECT * FROM ({SQL['forecast_metrics']}) WHERE metric = 'volatility'")(
    lambda s, d: FC.forecast_metrics(trade_hist(s, d)).drop("universe").where(F.col("metric") == "volatility"))


def readable(spark, sf):
    """Per universe's table and state: what a reader is told about a full, an empty and a missing table."""
    base, p = work_dir(spark, "readable"), S.event_prices(spark, sf)
    store.write_table(p, f"{base}/full", SC.PRICES)
    store.write_table(p.where("price IS NULL AND price IS NOT NULL"), f"{base}/empty", SC.PRICES)
    told = [(name, *store.is_readable(spark, f"{base}/{name}")) for name in ("full", "empty", "missing")]
    states = spark.createDataFrame(told, "stored string, readable boolean, reason string")
    return p.select("date").distinct().join(states.select("stored", "readable"))


query("stored_readable", with_("event_prices", """
    SELECT DISTINCT date, stored, stored = 'full' AS readable FROM event_prices, (VALUES ('full'), ('empty'), ('missing')) AS s(stored)"""))(readable)


def views(spark, sf):
    """The day table is written once; the views that need it alone read it back."""
    path = work_dir(spark, "hist")
    every = D.compute_all(S.trade_prices(spark, sf))
    every["hist"].write.parquet(path)
    v = D.views_of(spark.read.schema(every["hist"].schema).parquet(path))
    value = lambda c: rnd(F.col(c), 4).alias("value")
    parts = [v["hist"].select(F.lit("hist").alias("view"), F.col("date").cast("string").alias("key"), value("rolling_avg_7d")),
             v["sessions"].select(F.lit("sessions"), F.col("date").cast("string"), value("avg_pct")),
             v["streaks"].select(F.lit("streaks"), F.col("start_date").cast("string"), value("avg_pct")),
             v["cycles"].select(F.lit("cycles"), F.col("start_date").cast("string"), value("avg_return")),
             every["freq_movers"].select(F.lit("freq_movers"), "symbol", F.col("pct_days")),
             every["freq_losers"].select(F.lit("freq_losers"), "symbol", F.col("pct_days"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _view(name: str, key: str, value: str, sql: str) -> str:
    return f"SELECT '{name}' AS view, {key}::VARCHAR AS key, {value} AS value FROM ({sql})"


def _movers(side: str) -> str:
    keep, order = ("pct_change > 0", "pct_change DESC") if side == "up" else ("pct_change < 0", "pct_change")
    return with_("trade_prices", f"""
        SELECT symbol, {r('100.0 * count(*) / (SELECT count(DISTINCT date) FROM trade_prices)', 1)} AS pct_days FROM (
            SELECT symbol, row_number() OVER (PARTITION BY date ORDER BY {order}, symbol) AS k FROM trade_prices WHERE {keep})
        WHERE k <= {D.cfg.TOP_MOVERS_PER_DAY} GROUP BY symbol ORDER BY count(*) DESC, symbol LIMIT {D.cfg.TOP_MOVERS}""")


query("historical_views", " UNION ALL ".join([
    _view("hist", "date", r("rolling_avg_7d", 4), with_("trade_roll", "SELECT * FROM trade_roll")),
    _view("sessions", "date", r("avg_pct", 4), SQL["extreme_sessions"]), _view("streaks", "start_date", "avg_pct", SQL["streaks"]),
    _view("cycles", "start_date", "avg_return", SQL["market_cycles"]), _view("freq_movers", "symbol", "pct_days", _movers("up")),
    _view("freq_losers", "symbol", "pct_days", _movers("down"))]))(views)

query("news_listing", with_("sentiment", """
    SELECT date, row_number() OVER (PARTITION BY date ORDER BY sentiment_score DESC NULLS LAST, symbol)::INTEGER AS rank, symbol,
           sentiment_score, sentiment_label, top_headline FROM sentiment"""))(lambda s, d: SE.news_listing(sentiment(s, d)))

# --- a scorer fitted from labelled rows ------------------------------------------------------------------------------------

CTE["token_weights"] = ((), f"""
    SELECT token, {r('ln((p + 1) / (q + 1))', 6)} AS weight FROM (
        SELECT token, (count_if(quality = 1))::DOUBLE AS p, (count_if(quality = 0))::DOUBLE AS q FROM (
            SELECT quality, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+'))) AS token
            FROM documents JOIN labels USING (doc_id)) WHERE token <> '' GROUP BY token)
    WHERE p + q >= 20 ORDER BY p + q DESC, token LIMIT 500""")


def weights(spark, sf):
    labelled = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id")
    return SR.token_weights(labelled, "text", "quality")


query("token_weights", with_("token_weights", "SELECT * FROM token_weights"))(weights)
query("model_headline_scores", with_("raw_headlines token_weights", f"""
    SELECT h.doc_id, h.line, {r('coalesce(s.score, 0.0)', 4)} AS score, NULL::VARCHAR AS error FROM raw_headlines h LEFT JOIN (
        SELECT doc_id, line, avg(weight) AS score FROM (
            SELECT doc_id, line, unnest(regexp_split_to_array(lower(headline), '[^a-zà-ÿ]+')) AS token FROM raw_headlines)
        JOIN token_weights USING (token) GROUP BY doc_id, line) s USING (doc_id, line)"""))(
    lambda s, d: SR.scored(S.headlines(s, d).select("doc_id", "line", "headline"), "headline", SR.linear_scorer(weights(s, d))).drop("headline"))
