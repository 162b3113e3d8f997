"""Scan, ingestion, join, set, quality and calendar queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tickloom import schema as SC
from tickloom.functions.numeric import rnd
from tickloom.operators import calendar as C, daily as D, extend as E, forecast as FC, indicators as I, preprocess as P, \
    quality as Q, sentiment as SE, signals as G, stats as T
from tickloom.plans.detector_queries import (ALL_ANOM, ALL_SIGNALS, forecast_sql, fsql, sentiment, trade_anomalies, trade_enriched)
from tickloom.plans.market import event_hist, trade_hist
from tickloom.plans.registry import query
from tickloom.plans.sqlviews import CTE, HIST_COLS, ROLL_COLS, SYMBOL, daily_cte, r, roll_cte, w, with_
from tickloom.plans.symbols import messy_bars, ohlcv
from tickloom.sources import ingest as ING, sample as S, store
from tickloom.sources.market import tick_order

SPLIT = dt.date(2024, 1, 20)


def ep(spark, sf):
    return S.event_prices(spark, sf)


def recent_prices(spark, sf):
    """Snapshot rows: the part of the price table from SPLIT on."""
    return ep(spark, sf).where(F.col("date") >= F.lit(SPLIT))


# --- scans -----------------------------------------------------------------------------------------------------------
query("price_scan", with_("event_prices", "SELECT date, symbol, company_name, price, change, pct_change FROM event_prices"))(
    lambda s, d: SC.conform(ep(s, d), SC.PRICES))
query("latest_day", with_("event_prices", "SELECT * FROM event_prices WHERE date = (SELECT max(date) FROM event_prices)"))(
    lambda s, d: (lambda p: p.where(F.col("date") == p.select(F.max("date")).scalar()))(ep(s, d)))
query("sentiment_day", with_("sentiment", "SELECT * FROM sentiment WHERE date = DATE '1995-03-06'"))(
    lambda s, d: sentiment(s, d).where(F.col("date") == F.lit(dt.date(1995, 3, 6))))
query("bars_of_symbol", with_("trade_bars", "SELECT * FROM trade_bars WHERE symbol = 'NATION_7'"))(
    lambda s, d: S.trade_bars(s, d).where(F.col("symbol") == "NATION_7"))


def doubled(p):
    """Each row twice, the later copy with a different price: the first must survive."""
    return p.withColumn("seq", F.lit(1)).unionByName(p.withColumn("price", F.col("price") + 1).withColumn("seq", F.lit(2)))


query("dedup_keep_first", with_("event_prices", "SELECT date, symbol, price, 1::INTEGER AS seq FROM event_prices"))(
    lambda s, d: P.keep_one(doubled(ep(s, d)).select("date", "symbol", "price", "seq"), ["date", "symbol"], ["seq"]))
query("upsert_bars", with_("event_bars", """
    SELECT symbol, date, open, high, low, CASE WHEN date >= DATE '2024-01-20' THEN close + 1 ELSE close END AS close, volume
    FROM event_bars"""))(
    lambda s, d: (lambda b: P.upsert_bars(b.where(F.col("date") <= F.lit(dt.date(2024, 1, 25))),
                                          b.where(F.col("date") >= F.lit(SPLIT)).withColumn("close", F.col("close") + 1)))(
        S.event_bars(s, d)))
query("incremental_tail", with_("event_bars", "SELECT * FROM event_bars"))(
    lambda s, d: (lambda b: P.incremental_tail(b.where(F.col("date") < F.lit(SPLIT)), b))(S.event_bars(s, d)))
query("catalogue", with_("trade_bars", "SELECT DISTINCT symbol FROM trade_bars"))(
    lambda s, d: S.trade_bars(s, d).select("symbol").distinct())
query("dataset_summary", with_("event_prices", """
    SELECT count(*) AS n_rows, count(DISTINCT date) AS n_days, count(DISTINCT symbol) AS n_symbols, max(date) AS latest
    FROM event_prices"""))(
    lambda s, d: ep(s, d).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("date").alias("n_days"),
                              F.countDistinct("symbol").alias("n_symbols"), F.max("date").alias("latest")))
query("typed_table", with_("event_hist", """
    SELECT date, avg_pct::VARCHAR AS metric, TRY_CAST(CASE WHEN n_gainers % 2 = 0 THEN 'x' ELSE breadth_pct::VARCHAR END AS DOUBLE)
           AS forecast, NULL::DOUBLE AS lower_bound, NULL::DOUBLE AS upper_bound, 'm' AS method
    FROM (SELECT *, 1 FROM event_hist)""").replace("avg_pct::VARCHAR AS metric", "'avg_pct' AS metric"))(
    lambda s, d: SC.conform(event_hist(s, d).select(
        "date", F.lit("avg_pct").alias("metric"), F.lit("m").alias("method"),
        F.when(F.col("n_gainers") % 2 == 0, F.lit("x")).otherwise(F.col("breadth_pct").cast("string")).alias("forecast")),
        SC.FORECASTS))


# --- payloads --------------------------------------------------------------------------------------------------------
def quote_payloads(spark, sf):
    """One payload per price row, with an unusable quote on either side of the good one."""
    def q(symbol, price, short, long):
        return F.struct(symbol.alias("symbol"), price.alias("regularMarketPrice"), F.col("change").alias("regularMarketChange"),
                        F.col("pct_change").alias("regularMarketChangePercent"), short.alias("shortName"), long.alias("longName"))
    s, p, none = F.col("symbol"), F.col("price"), F.lit(None).cast("string")
    quotes = F.array(q(F.lit(""), p, none, none), q(s, p, F.lit(""), F.concat(s, F.lit(", Inc"))),
                     q(s, F.lit(None).cast("double"), s, s), q(s, -p, s, s))
    body = F.struct(F.struct(F.array(F.struct(quotes.alias("quotes"))).alias("result")).alias("finance"))
    return ep(spark, sf).select("date", F.to_json(body).alias("payload"))


query("quotes_from_json", with_("event_prices", f"""
    SELECT date, symbol, symbol || ' Inc' AS company_name, {r('price', 2)} AS price, {r('change', 4)} AS change,
           {r('pct_change', 4)} AS pct_change FROM event_prices WHERE price > 0 AND pct_change IS NOT NULL"""))(
    lambda s, d: ING.quotes_from_json(quote_payloads(s, d), keep=["date"]))
query("any_to_date", """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(ts AS DATE) END AS date FROM events""")(
    lambda s, d: S.table(s, d, "events").select("event_id", ING.to_day(
        F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("string")).when(F.col("event_id") % 3 == 1, F.col("ts").cast("date").cast("string"))
        .otherwise("no date")).alias("date")))
query("event_props_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(
    lambda s, d: S.table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")))


def html_pages(spark, sf):
    """One page per price row: header, a short row to skip, and the row itself with thousands separators."""
    row = F.format_string(
        "<table><tbody><tr><td>Symbol</td><td>Name</td><td>x</td></tr><tr><td>only</td><td>two</td></tr>"
        "<tr class=\"r\"><td><a>%s</a></td><td>%s, Corp</td><td><span>%,.2f</span> <b>%+.2f</b> (%+.2f%%)</td></tr></tbody></table>",
        F.col("symbol"), F.col("symbol"), F.col("price"), rnd(F.col("change"), 2), rnd(F.col("pct_change"), 2))
    return ep(spark, sf).select("date", row.alias("html"))


query("rows_from_html", with_("event_prices", f"""
    SELECT date, symbol, symbol || ' Corp' AS company_name, p AS price, c AS change,
           CASE WHEN abs(c) >= 0.01 THEN {r('c / nullif(p - c, 0) * 100', 2)} ELSE k END AS pct_change
    FROM (SELECT date, symbol, {r('price', 2)} AS p, {r('change', 2)} AS c, {r('pct_change', 2)} AS k FROM event_prices)
    WHERE p > 0"""))(lambda s, d: ING.prices_from_html(html_pages(s, d), keep=["date"]))
query("html_rows_in_pages", """
    SELECT count(*) AS n_pages, count_if(regexp_matches(lower(html), '<tr[ >]'))::BIGINT AS n_with_rows FROM pages""")(
    lambda s, d: (lambda p: p.agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.size(F.regexp_extract_all(
        "html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))) > 0).alias("n_with_rows")))(S.table(s, d, "pages")))


def news_payloads(spark, sf):
    h = S.headlines(spark, sf).select("symbol", "date", "doc_id", "line", "headline")
    epoch = F.unix_date("date").cast("long") * 86400 + 3600
    art = F.array(F.struct(epoch.alias("datetime"), F.concat(F.lit("  "), "headline", F.lit(" ")).alias("headline")),
                  F.struct(epoch.alias("datetime"), F.lit("abc").alias("headline")))
    return h.select("symbol", "doc_id", "line", F.to_json(art).alias("articles"))


query("news_by_day", with_("sentiment", "SELECT * FROM sentiment"))(
    lambda s, d: SE.headline_sentiment(ING.news_articles(news_payloads(s, d), keep=["doc_id", "line"]).withColumn(
        "score", SE.lexicon_score(F.col("headline"), S.SAMPLE_LEXICON))))
query("source_failures", f"""
    SELECT symbol, count(*) AS consecutive_failures, max(date) AS last_failure, count(*) >= 3 AS skip FROM (
        SELECT {SYMBOL} AS symbol, CAST(ts AS DATE) AS date, event_type,
               count_if(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS later_ok FROM events)
    WHERE later_ok = 0 AND event_type = 'error' GROUP BY symbol""")(
    lambda s, d: ING.source_failures(
        S.event_ticks(s, d).withColumn("success", F.col("event_type") != "error"), tick_order(F.col("ts"), F.col("event_id"))))
MACRO_DAY = dt.date(2001, 10, 30)
query("macro_series", with_("trade_bars", """
    SELECT symbol AS series_alias, date, vwap AS value, date_diff('day', max(date) OVER (PARTITION BY symbol), DATE '2001-10-30') <= 7
           AS recent FROM trade_bars WHERE vwap IS NOT NULL"""))(
    lambda s, d: ING.macro_series(S.trade_bars(s, d).select(F.col("symbol").alias("series_alias"), "date",
                                                           F.col("vwap").alias("value")), F.lit(MACRO_DAY)))
CHART = ["date", "close", "sma_20", "sma_50", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower"]


def symbol_records(spark, sf):
    """The exported JSON texts parsed back to rows."""
    texts = store.symbol_json(I.indicator_suite(ohlcv(spark, sf), complete=True), CHART)
    record = ", ".join(f"{c} {'date' if c == 'date' else 'double'}" for c in CHART)
    return texts.select("symbol", "n_rows", F.inline(F.from_json("json", f"array<struct<{record}>>")))


query("symbol_json_export", with_("suite", f"""
    SELECT symbol, n_rows, {', '.join(CHART)} FROM (SELECT *, count(close) OVER (PARTITION BY symbol) AS n_rows FROM suite)
    WHERE close IS NOT NULL AND n_rows >= 20"""))(symbol_records)

# --- sentiment -------------------------------------------------------------------------------------------------------
query("headline_scores", with_("headlines", "SELECT * FROM headlines"))(S.headlines)
query("headline_sentiment", with_("sentiment", "SELECT * FROM sentiment"))(sentiment)


def lexicon_df(spark, sf):
    # From literals, so that Spark knows the size and never shuffles texts by token.
    rows = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(w).alias("weight")) for t, w in S.SAMPLE_LEXICON.items()])
    return spark.range(1).select(F.inline(rows))


query("headline_scores_joined", with_("headlines", "SELECT doc_id || '-' || line AS id, score FROM headlines"))(
    lambda s, d: SE.lexicon_table_score(S.headlines(s, d).select(F.concat_ws("-", "doc_id", "line").alias("id"), "headline"), "id", "headline", lexicon_df(s, d)))
DS = f"SELECT date, {r('avg_score', 6)} AS avg_score, {r(f'avg(avg_score) OVER {w(7)}', 6)} AS rolling_7d FROM daily_sent"
query("daily_sentiment", with_("daily_sent", DS))(
    lambda s, d: SE.daily_sentiment(sentiment(s, d)).select(
        "date", *[rnd(F.col(c), 6).alias(c) for c in ("avg_score", "rolling_7d")]))
VIX = "20 + 5 * (volatility - avg(volatility) OVER ()) / nullif(stddev_samp(volatility) OVER (), 0)"
CTE["vix"] = (("trade_hist",), f"SELECT date, {VIX} AS vix FROM trade_hist WHERE volatility IS NOT NULL")
query("vix_score", with_("vix", f"SELECT date, {r('-tanh((vix - 20) / 10)', 4)} AS score FROM vix"))(
    lambda s, d: S.vix_like(trade_hist(s, d)).select("date", SE.vix_score(F.col("vix")).alias("score")))
query("extended_sentiment", with_("vix daily_sent", f"""
    SELECT date, {r('avg_score', 6)} AS avg_score, source, {r('avg(avg_score) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 4)}
           AS rolling_7d FROM (SELECT date, avg_score, 'nlp' AS source FROM daily_sent UNION ALL
           SELECT date, {r('-tanh((vix - 20) / 10)', 4)}, 'vix' FROM vix WHERE date NOT IN (SELECT date FROM daily_sent))"""))(
    lambda s, d: SE.extended_sentiment(SE.daily_sentiment(sentiment(s, d)), S.vix_like(trade_hist(s, d)))
    .withColumn("avg_score", rnd(F.col("avg_score"), 6)))
SB = f"""
    SELECT *, CASE WHEN n_total = 0 THEN 'Neutral' WHEN n_bullish > n_bearish AND n_bullish > n_neutral THEN 'Risk-On'
           WHEN n_bearish > n_bullish AND n_bearish > n_neutral THEN 'Risk-Off' WHEN mean_score >= 0.05 THEN 'Cautiously Bullish'
           WHEN mean_score <= -0.05 THEN 'Cautiously Bearish' ELSE 'Mixed' END AS regime FROM (
    SELECT date, count(*) AS n_total, count_if(sentiment_label = 'Bullish')::BIGINT AS n_bullish,
           count_if(sentiment_label = 'Bearish')::BIGINT AS n_bearish, count_if(sentiment_label = 'Neutral')::BIGINT AS n_neutral,
           count_if(sentiment_label = 'No Data')::BIGINT AS n_no_data,
           {', '.join(f"{r(f'''count_if(sentiment_label = '{l}') / count(*) * 100''', 1)} AS pct_{n}" for l, n in
                      (('Bullish', 'bullish'), ('Bearish', 'bearish'), ('Neutral', 'neutral'), ('No Data', 'no_data')))},
           {r('coalesce(avg(sentiment_score), 0.0)', 4)} AS mean_score FROM sentiment GROUP BY date)"""
query("sentiment_breadth", with_("sentiment", SB))(lambda s, d: SE.sentiment_breadth(sentiment(s, d), ["date"]))
query("top_sentiment", with_("sentiment", """
    SELECT * FROM (SELECT * FROM sentiment WHERE sentiment_label = 'Bullish' ORDER BY sentiment_score DESC, date, symbol LIMIT 5)
    UNION ALL SELECT * FROM (SELECT * FROM sentiment WHERE sentiment_label = 'Bearish' ORDER BY sentiment_score, date, symbol LIMIT 5)"""))(
    lambda s, d: (lambda x: SE.top_sentiment(x, "Bullish").unionByName(SE.top_sentiment(x, "Bearish")))(sentiment(s, d)))
query("sentiment_price_corr", with_("trade_prices sentiment", f"""
    SELECT symbol, count(*) AS n, CASE WHEN count(*) >= 3 THEN nullif({r('corr(sentiment_score, pct_change)', 4)}, 'NaN'::DOUBLE)
           ELSE 0.0 END AS corr FROM trade_prices JOIN sentiment USING (symbol, date)
    WHERE sentiment_score IS NOT NULL AND pct_change IS NOT NULL GROUP BY symbol"""))(
    lambda s, d: T.pearson(S.trade_prices(s, d).join(sentiment(s, d), ["symbol", "date"]), "sentiment_score", "pct_change", ["symbol"]))
query("sentiment_cover", with_("trade_prices sentiment", """
    SELECT p.date, p.symbol, s.sentiment_score, coalesce(s.sentiment_label, 'No Data') AS sentiment_label,
           coalesce(s.headlines_used, 0) AS headlines_used, coalesce(s.top_headline, 'No headlines available') AS top_headline
    FROM trade_prices p LEFT JOIN sentiment s USING (date, symbol)"""))(
    lambda s, d: SE.cover_symbols(sentiment(s, d), S.trade_prices(s, d).select("date", "symbol")))

# --- joins and sets --------------------------------------------------------------------------------------------------
WS = "date, symbol, price, change, pct_change, sentiment_score, sentiment_label"
query("enrich_sentiment", with_("with_sent", f"SELECT {WS} FROM with_sent"))(
    lambda s, d: G.enrich_sentiment(S.trade_prices(s, d), sentiment(s, d)).select(*WS.split(", ")))
query("enrich_sentiment_asof", with_("trade_prices sentiment", """
    SELECT p.date, p.symbol, p.price, p.pct_change, s.sentiment_score, s.sentiment_label, s.date AS sent_date
    FROM trade_prices p ASOF LEFT JOIN sentiment s ON p.symbol = s.symbol AND p.date >= s.date"""))(
    lambda s, d: SE.asof_sentiment(S.trade_prices(s, d), sentiment(s, d)))
query("prior_dates_anti", with_("event_bars", "SELECT * FROM event_bars WHERE date < DATE '2024-01-20'"))(
    lambda s, d: E.days_not_in(S.event_bars(s, d), recent_prices(s, d)))
query("new_keys_anti", with_("trade_prices sentiment", """
    SELECT date, symbol, price FROM trade_prices p WHERE NOT EXISTS (SELECT 1 FROM sentiment s WHERE s.date = p.date AND s.symbol = p.symbol)"""))(
    lambda s, d: E.keys_not_in(S.trade_prices(s, d).select("date", "symbol", "price"), sentiment(s, d)))
GRID = """(SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date
           FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM event_bars GROUP BY symbol))"""
query("missing_days", with_("event_bars", f"""
    SELECT symbol, date FROM {GRID} g WHERE isodow(date) < 6 AND NOT EXISTS (
        SELECT 1 FROM event_bars b WHERE b.symbol = g.symbol AND b.date = g.date)"""))(
    lambda s, d: E.missing_days(S.event_bars(s, d)))
query("missing_market_days", with_("trade_prices", """
    SELECT date FROM (SELECT unnest(generate_series(greatest(min(date), max(date) - 30), max(date), INTERVAL 1 DAY))::DATE AS date
                      FROM trade_prices) WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM trade_prices)"""))(
    lambda s, d: E.missing_market_days(S.trade_prices(s, d)))
query("business_grid", with_("event_bars", f"SELECT symbol, date FROM {GRID} WHERE isodow(date) < 6"))(
    lambda s, d: P.business_grid(S.event_bars(s, d)))
query("hist_vs_sentiment", with_("trade_hist daily_sent", f"""
    SELECT date, avg_pct, volatility, breadth_pct, {r('avg_score', 6)} AS avg_score FROM trade_hist JOIN (
        SELECT date, avg_score FROM daily_sent) USING (date)"""))(
    lambda s, d: trade_hist(s, d).select("date", "avg_pct", "volatility", "breadth_pct").join(
        SE.daily_sentiment(sentiment(s, d)).select("date", rnd(F.col("avg_score"), 6).alias("avg_score")), "date"))
query("company_names", with_("event_prices", "SELECT symbol, first(company_name ORDER BY date) AS company_name FROM event_prices GROUP BY symbol"))(
    lambda s, d: E.company_names(ep(s, d)))
query("symbols_with_bars", with_("event_prices event_bars", """
    SELECT symbol, price FROM event_prices WHERE date = (SELECT max(date) FROM event_prices) AND symbol IN (
        SELECT symbol FROM event_bars GROUP BY symbol HAVING count(*) >= 20)"""))(
    lambda s, d: (lambda p, b: p.where(F.col("date") == p.select(F.max("date")).scalar()).select("symbol", "price").join(
        b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n >= 20"), "symbol", "left_semi"))(ep(s, d), S.event_bars(s, d)))
CTE["snap"] = (("event_prices",), "SELECT * FROM event_prices WHERE date >= DATE '2024-01-20'")
CTE["ext_prices"] = (("snap", "event_prices"), f"""
    SELECT universe, date, symbol, company_name, {r('price', 4)} AS price, {r('change', 4)} AS change, {r('pct_change', 4)} AS pct_change
    FROM event_prices WHERE date < DATE '2024-01-20' AND symbol IN (SELECT symbol FROM snap) UNION ALL SELECT * FROM snap""")
query("extended_prices", with_("ext_prices", "SELECT * FROM ext_prices"))(
    lambda s, d: E.extended_prices(S.event_bars(s, d), recent_prices(s, d)))
CTE["ext_hist"] = (("event_hist",), f"""
    SELECT universe, date, n_gainers, n_losers, n_flat, CASE WHEN old THEN {r('avg_pct', 4)} ELSE avg_pct END AS avg_pct,
           CASE WHEN old THEN {r('coalesce(volatility, 0.0)', 4)} ELSE volatility END AS volatility, skew_pct, kurt_pct, breadth_pct,
           CASE WHEN old THEN 'bars' ELSE 'scraped' END AS source
    FROM (SELECT *, date < DATE '2024-01-20' AS old FROM event_hist)""")
CTE["ext_roll"] = (("ext_hist",), roll_cte("ext_hist"))
query("extended_hist", with_("ext_roll", f"SELECT date, n_gainers, avg_pct, volatility, breadth_pct, source, {ROLL_COLS} FROM ext_roll"))(
    lambda s, d: E.extended_hist(S.event_bars(s, d), recent_prices(s, d)).select(
        "date", "n_gainers", "avg_pct", "volatility", "breadth_pct", "source", *[x.strip() for x in ROLL_COLS.split(",")]))
query("top_and_bottom_symbols", with_("event_prices", """
    , f AS (SELECT symbol, max(price) AS p FROM event_prices GROUP BY symbol)
    SELECT symbol FROM (SELECT symbol FROM f ORDER BY p DESC, symbol LIMIT 15) UNION SELECT symbol FROM (SELECT symbol FROM f ORDER BY p, symbol LIMIT 15)""")
      .replace(")\n\n    , f AS", "),\n f AS"))(
    lambda s, d: (lambda f: f.orderBy(F.col("p").desc(), "symbol").limit(15).select("symbol").union(
        f.orderBy("p", "symbol").limit(15).select("symbol")).distinct())(ep(s, d).groupBy("symbol").agg(F.max("price").alias("p"))))
query("date_sets", with_("trade_prices sentiment", """
    SELECT date, 'both' AS kind FROM (SELECT date FROM trade_prices INTERSECT SELECT date FROM sentiment)
    UNION ALL SELECT date, 'prices_only' FROM (SELECT date FROM trade_prices EXCEPT SELECT date FROM sentiment)"""))(
    lambda s, d: (lambda a, b: a.intersect(b).withColumn("kind", F.lit("both")).unionByName(
        a.exceptAll(a.intersect(b)).distinct().withColumn("kind", F.lit("prices_only"))))(
        S.trade_prices(s, d).select("date").distinct(), sentiment(s, d).select("date").distinct()))
query("dirty_days", with_("event_prices", """
    SELECT date FROM (SELECT date, count(*) AS n FROM event_prices GROUP BY date) a
    LEFT JOIN (SELECT date, count(*) AS n FROM event_prices WHERE day(date) % 7 <> 0 AND (date < DATE '2024-01-20' OR symbol > 'U0010')
               GROUP BY date) b USING (date) WHERE b.n IS NULL OR a.n <> b.n"""))(
    lambda s, d: (lambda p: dirty_days(p, p.where((F.dayofmonth("date") % 7 != 0) & (
        (F.col("date") < F.lit(SPLIT)) | (F.col("symbol") > "U0010")))))(ep(s, d)))


def dirty_days(current, stored):
    from tickloom.streaming.incremental import dirty_days as impl
    return impl(current, stored)


# --- quality ---------------------------------------------------------------------------------------------------------
def bad_prices(p):
    """A price table with seeded faults derived from the good one."""
    day, tail = F.dayofmonth("date"), F.substring("symbol", -1, 1)
    price = F.when((day % 9 == 0) & (tail == "3"), F.lit(0.001)).when((day == 11) & (tail == "4"), F.lit(200000.0)).otherwise(F.col("price"))
    one = p.withColumn("price", price).withColumn("change", F.when((day == 5) & (tail == "1"), F.lit(None)).otherwise(F.col("change")))
    return one.unionByName(one.where((day == 12) & (tail == "2")))


CTE["bad1"] = (("event_prices",), """
    SELECT date, symbol, CASE WHEN day(date) % 9 = 0 AND right(symbol, 1) = '3' THEN 0.001 WHEN day(date) = 11 AND right(symbol, 1) = '4'
           THEN 200000.0 ELSE price END AS price, CASE WHEN day(date) = 5 AND right(symbol, 1) = '1' THEN NULL ELSE change END AS change,
           pct_change FROM event_prices""")
CTE["bad"] = (("bad1",), "SELECT * FROM bad1 UNION ALL SELECT * FROM bad1 WHERE day(date) = 12 AND right(symbol, 1) = '2'")


def tidy(rows: list[tuple[str, str, str]], src: str, keep: str = "") -> str:
    k = f"{keep}, " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {k}'{n}' AS \"check\", CASE WHEN {x} > 0 THEN {sev} ELSE 'ok' END AS severity, ({x})::BIGINT AS n_bad FROM {src}"
        for n, x, sev in rows)


WARN = "'warning'"
query("dq_prices", with_("bad", tidy(
    [(f"null_{x}", f"n_{x}", WARN) for x in ("symbol", "price", "change", "pct_change")] +
    [("price_below_min", "lo", WARN), ("price_above_max", "hi", WARN),
     ("duplicate_keys", "dup", "CASE WHEN dup / n > 0.01 THEN 'error' ELSE 'warning' END"),
     ("latest_day_rows_missing", "greatest(50 - latest, 0)", WARN)],
    "(SELECT count(*) AS n, " + ", ".join(f"count_if({x} IS NULL) AS n_{x}" for x in ("symbol", "price", "change", "pct_change")) +
    ", count_if(price < 0.01) AS lo, count_if(price > 100000) AS hi, count(*) - count(DISTINCT (date, symbol)) AS dup,"
    " count_if(date = (SELECT max(date) FROM bad)) AS latest FROM bad)")))(lambda s, d: Q.dq_prices(bad_prices(ep(s, d))))


def bad_sentiment(x):
    score = F.when(F.col("symbol") == "NATION_3", F.col("sentiment_score") + 3).otherwise(F.col("sentiment_score"))
    label = F.when(F.col("symbol") == "NATION_4", F.lit("Odd")).otherwise(F.col("sentiment_label"))
    y = x.withColumn("sentiment_score", score).withColumn("sentiment_label", label)
    return y.unionByName(y.where(F.col("symbol") == "NATION_5"))


CTE["bad_s1"] = (("sentiment",), """SELECT date, symbol, CASE WHEN symbol = 'NATION_3' THEN sentiment_score + 3 ELSE sentiment_score END
    AS sentiment_score, CASE WHEN symbol = 'NATION_4' THEN 'Odd' ELSE sentiment_label END AS sentiment_label FROM sentiment""")
CTE["bad_s"] = (("bad_s1",), "SELECT * FROM bad_s1 UNION ALL SELECT * FROM bad_s1 WHERE symbol = 'NATION_5'")
query("dq_sentiment", with_("bad_s", tidy(
    [("score_out_of_range", "a", WARN), ("unknown_label", "b", WARN), ("duplicate_keys", "c", WARN)],
    "(SELECT count_if(sentiment_score < -1 OR sentiment_score > 1) AS a, count_if(sentiment_label NOT IN ('Bullish', 'Bearish', "
    "'Neutral', 'No Data')) AS b, count(*) - count(DISTINCT (date, symbol)) AS c FROM bad_s)")))(
    lambda s, d: Q.dq_sentiment(bad_sentiment(sentiment(s, d))))
query("dq_forecast", fsql("trade_prices bdays", "trade_prices", "symbol", "price", "linear").replace(
    "SELECT symbol, bday AS date", "SELECT 'non_numeric_bounds' AS \"check\", 'ok' AS severity, 0::BIGINT AS n_bad UNION ALL "
    "SELECT 'invalid_bounds', CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END, count(*) FROM (SELECT symbol, bday AS date", 1)
    .replace("WHERE step <= 5", "WHERE step <= 5) WHERE symbol = 'NATION_3'"))(
    lambda s, d: Q.dq_forecast(FC.forecast_series(S.trade_prices(s, d), ["symbol"], "price", "linear").withColumn(
        "upper_bound", F.when(F.col("symbol") == "NATION_3", F.col("lower_bound") - 1).otherwise(F.col("upper_bound")))))
query("dq_signals", with_("te", tidy([("unknown_direction", "a", WARN), ("non_numeric_score", "b", WARN)],
      f"(SELECT count_if(symbol = 'NATION_6') AS a, 0 AS b FROM ({ALL_SIGNALS}))")))(
    lambda s, d: Q.dq_signals(G.all_signals(trade_enriched(s, d)).withColumn(
        "direction", F.when(F.col("symbol") == "NATION_6", F.lit("Sideways")).otherwise(F.col("direction")))))
query("dq_anomalies", with_("te trade_hist daily_sent", tidy(
    [("unknown_severity", "0", WARN), ("non_numeric_z", "0", WARN), ("extreme_z", "a", WARN), ("cluster_share_above_one", "b", WARN)],
    f"(SELECT count_if(anomaly_type <> 'cluster_spike' AND abs(z_score) > 10) AS a, count_if(anomaly_type = 'cluster_spike' "
    f"AND abs(z_score) > 1) AS b FROM ({ALL_ANOM}))")))(lambda s, d: Q.dq_anomalies(trade_anomalies(s, d)))
query("dq_depth", with_("event_prices", tidy(
    [("min_history_days", "greatest(3 - d, 0)", WARN), ("short_window_rows", "greatest(7 - d, 0)", WARN),
     ("long_window_rows", "CASE WHEN d < 7 THEN 0 ELSE greatest(30 - d, 0) END", WARN)],
    "(SELECT count(DISTINCT date) AS d FROM event_prices)")))(lambda s, d: Q.dq_depth(ep(s, d)))
NULLS = ["var_5", "cvar_5", "tail_ratio", "vol_pct_rank", "rolling_signal_7d", "avg_pct"]
query("dq_nulls", with_("event_roll", " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", {r(f'count_if({x} IS NULL) / count(*)', 6)} AS null_rate, CASE WHEN count_if({x} IS NULL) / count(*) "
    f"> 0.5 THEN 'warning' ELSE 'ok' END AS severity FROM event_roll" for x in NULLS)))(
    lambda s, d: Q.null_density(D.rolling_intelligence(event_hist(s, d)), NULLS))
CTE["messy"] = (("event_bars",), """
    SELECT symbol, date, open, high, low, close, volume, 0 AS seq FROM event_bars UNION ALL
    SELECT symbol, date, open, low, high, CASE WHEN day(date) = 10 THEN NULL ELSE close END, -volume, 1 FROM event_bars WHERE day(date) % 5 = 0""")
query("dq_bars", with_("messy event_bars", tidy(
    [("close_all_null", "dead", "'error'"), ("close_not_positive", "np", WARN), ("high_below_low", "inv", WARN),
     ("duplicate_dates", "dup", WARN), ("zero_volume", "zero", WARN), ("overnight_gap", "gaps", WARN), ("rows_missing", "miss", WARN)],
    """(SELECT symbol, (count(close) = 0)::INTEGER AS dead, count_if(close <= 0) AS np, count_if(high < low) AS inv,
        count(*) - count(DISTINCT date) AS dup, count_if(volume = 0) AS zero, any_value(g.gaps) AS gaps, greatest(60 - count(*), 0) AS miss
        FROM messy JOIN (SELECT symbol, count_if(abs((open - p) / nullif(p, 0)) > 0.15) AS gaps FROM (SELECT *, lag(close) OVER (
        PARTITION BY symbol ORDER BY date) AS p FROM event_bars) GROUP BY symbol) g USING (symbol) GROUP BY symbol)""", "symbol")))(
    lambda s, d: Q.dq_bars(messy_bars(s, d), ["seq"]))
query("dq_features", with_("suite", " UNION ALL ".join(
    f"SELECT symbol, '{x}' AS \"column\", {r(f'count_if({x} IS NULL) / count(*)', 6)} AS null_rate, CASE WHEN count_if({x} IS NULL) "
    f"/ count(*) > 0.5 THEN 'warning' ELSE 'ok' END AS severity FROM suite GROUP BY symbol" for x in Q.KEY_INDICATORS)))(
    lambda s, d: Q.dq_features(I.indicator_suite(ohlcv(s, d), complete=True)))

# --- calendar --------------------------------------------------------------------------------------------------------
OBS = "CASE isodow({d}) WHEN 6 THEN {d} - 1 WHEN 7 THEN {d} + 1 ELSE {d} END"


def obs(m: int, d: int) -> str:
    return OBS.format(d=f"make_date(year, {m}, {d})")


def nth(m: int, wd: int, n: int) -> str:
    return (f"(SELECT dd FROM (SELECT make_date(year, {m}, 1) + CAST(i AS INTEGER) AS dd FROM range(31) t(i)) "
            f"WHERE isodow(dd) = {wd} AND month(dd) = {m} ORDER BY dd LIMIT 1 OFFSET {n - 1})")


# The published dates of Good Friday.
GOOD_FRIDAYS = """
1990-04-13 1991-03-29 1992-04-17 1993-04-09 1994-04-01 1995-04-14 1996-04-05 1997-03-28 1998-04-10 1999-04-02
2000-04-21 2001-04-13 2002-03-29 2003-04-18 2004-04-09 2005-03-25 2006-04-14 2007-04-06 2008-03-21 2009-04-10
2010-04-02 2011-04-22 2012-04-06 2013-03-29 2014-04-18 2015-04-03 2016-03-25 2017-04-14 2018-03-30 2019-04-19
2020-04-10 2021-04-02 2022-04-15 2023-04-07 2024-03-29 2025-04-18 2026-04-03 2027-03-26 2028-04-14 2029-03-30
""".split()


def holiday_cte(years: str) -> str:
    """The Spark side counts from the epact; here Good Friday is looked up."""
    last_mon = ("(SELECT max(dd) FROM (SELECT make_date(year, 5, 1) + CAST(i AS INTEGER) AS dd FROM range(31) t(i)) WHERE isodow(dd) = 1)")
    fridays = ", ".join(f"(DATE '{d}')" for d in GOOD_FRIDAYS)
    return f"""
        SELECT year, holiday, date::DATE AS date FROM (
        SELECT year, unnest(['New Year', 'Martin Luther King', 'Presidents', 'Good Friday', 'Memorial', 'Juneteenth', 'Independence',
                             'Labor', 'Thanksgiving', 'Christmas']) AS holiday,
               unnest([{obs(1, 1)}, {nth(1, 1, 3)}, {nth(2, 1, 3)}, friday,
                       {last_mon}, {obs(6, 19)}, {obs(7, 4)}, {nth(9, 1, 1)}, {nth(11, 4, 4)}, {obs(12, 25)}]) AS date
        FROM ({years}) LEFT JOIN (SELECT friday, year(friday) AS year FROM (VALUES {fridays}) AS f(friday)) USING (year))"""


CTE["hol_orders"] = ((), holiday_cte("SELECT DISTINCT year(o_orderdate)::INTEGER AS year FROM orders"))
query("holidays", with_("hol_orders", "SELECT * FROM hol_orders"))(
    lambda s, d: C.holidays(S.table(s, d, "orders").select(F.year("o_orderdate").alias("year"))))
CTE["cal"] = (("hol_cal",), """
    SELECT date, is_holiday, trading AS is_trading_day, max(CASE WHEN trading THEN date END) OVER (ORDER BY date) AS last_trading_day
    FROM (SELECT date, date IN (SELECT date FROM hol_cal) AS is_holiday,
                 isodow(date) < 6 AND date NOT IN (SELECT date FROM hol_cal) AS trading FROM caldays)""")
CTE["caldays"] = ((), """SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)) - 14, max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY))::DATE
    AS date FROM orders""")
CTE["hol_cal"] = (("caldays",), holiday_cte("SELECT DISTINCT unnest([year(date), year(date) + 1])::INTEGER AS year FROM caldays"))
query("trading_days", with_("cal", "SELECT * FROM cal"))(
    lambda s, d: C.trading_calendar(S.table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))))
CTE["hol_ev"] = ((), holiday_cte("SELECT unnest([2023, 2024])::INTEGER AS year"))
query("last_trading_day", with_("hol_ev", """
    , ev AS (SELECT event_id, CASE WHEN hour(ts - INTERVAL 5 HOUR) < 16 THEN CAST(ts - INTERVAL 5 HOUR AS DATE) - 1
                    ELSE CAST(ts - INTERVAL 5 HOUR AS DATE) END AS d FROM events),
    td AS (SELECT dd FROM (SELECT DATE '2023-12-01' + CAST(i AS INTEGER) AS dd FROM range(100) t(i))
           WHERE isodow(dd) < 6 AND dd NOT IN (SELECT date FROM hol_ev))
    SELECT event_id, dd AS last_closed FROM ev ASOF JOIN td ON ev.d >= td.dd""").replace(")\n\n    , ev AS", "),\n ev AS"))(
    lambda s, d: C.last_closed_day(S.table(s, d, "events").select("event_id", "ts"), "ts").select("event_id", "last_closed"))
