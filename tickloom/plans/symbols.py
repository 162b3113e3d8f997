"""Symbol-level queries: windows, indicators, cleaning, projections over bars and prices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tickloom.functions import ladders, windows as W
from tickloom.functions.numeric import div, rnd
from tickloom.operators import indicators as I, preprocess as P, resume as RS
from tickloom.plans.market import event_hist, trade_hist
from tickloom.operators.stats import pct_discrepancy
from tickloom.plans.registry import query
from tickloom.plans.sqlviews import CTE, ema_sql, ewm_sql, r, w, with_
from tickloom.sources import sample as S
from tickloom.sources.ingest import pct_recompute
from tickloom.streaming.runtime import work_dir

w7, w20, w30, w50 = (w(n, "symbol") for n in (7, 20, 30, 50))
LAG = "lag({}) OVER (PARTITION BY symbol ORDER BY date)"


def lag(x: str, n: int = 1, by: str = "symbol") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {by} ORDER BY date)"


def mom(x: str, n: int, by: str = "symbol") -> str:
    return r(f"({x} - {lag(x, n, by)}) / nullif(abs({lag(x, n, by)}), 0)", 4)


def z(x: str, over: str) -> str:
    return r(f"({x} - avg({x}) OVER {over}) / nullif(stddev_samp({x}) OVER {over}, 0)", 4)


def trend(a: str, b: str) -> str:
    g = f"(({a}) - ({b})) / nullif(abs({b}), 0)"
    return f"CASE WHEN {g} > 0.005 THEN 'Bullish' WHEN {g} < -0.005 THEN 'Bearish' ELSE 'Neutral' END"


# --- moving averages and friends ------------------------------------------------------------------------------------
query("sma_ema", with_("trade_prices", f"""
    SELECT symbol, date, {r(f'avg(price) OVER {w7}', 4)} AS sma_7, {r(ema_sql('price', 7, 'symbol'), 4)} AS ema_7
    FROM trade_prices"""))(
    lambda s, d: I.sma_ema(S.trade_prices(s, d), "price", 7).select("symbol", "date", "sma_7", "ema_7"))

query("rolling_vol_momentum", with_("trade_prices", f"""
    SELECT symbol, date, {r(f'stddev_samp(pct_change) OVER {w30}', 4)} AS vol_30, {mom('price', 7)} AS mom_7
    FROM trade_prices"""))(
    lambda s, d: S.trade_prices(s, d).select(
        "symbol", "date", rnd(W.std(F.col("pct_change"), W.trailing(["symbol"], 30)), 4).alias("vol_30"),
        rnd(W.momentum(F.col("price"), 7, W.ordered(["symbol"])), 4).alias("mom_7")))

query("signal_strength", with_("event_prices", f"SELECT symbol, date, {z('pct_change', w7)} AS z_7 FROM event_prices"))(
    lambda s, d: S.event_prices(s, d).select(
        "symbol", "date", rnd(W.zscore(F.col("pct_change"), W.trailing(["symbol"], 7)), 4).alias("z_7")))

query("trend_class", with_("trade_prices", f"""
    SELECT symbol, date, {trend('a', 'b')} AS trend
    FROM (SELECT *, {r(f'avg(price) OVER {w7}', 4)} AS a, {r(f'avg(price) OVER {w30}', 4)} AS b FROM trade_prices)"""))(
    lambda s, d: S.trade_prices(s, d).select(
        "symbol", "date", rnd(W.mean(F.col("price"), W.trailing(["symbol"], 7)), 4).alias("a"),
        rnd(W.mean(F.col("price"), W.trailing(["symbol"], 30)), 4).alias("b"))
    .select("symbol", "date", ladders.trend(F.col("a"), F.col("b")).alias("trend")))

query("rel_momentum", with_("event_prices", f"""
    SELECT symbol, date, {r('pct_change - avg(pct_change) OVER (PARTITION BY date)', 4)} AS rel_momentum
    FROM event_prices"""))(
    lambda s, d: (lambda p: p.join(I.market_average(p), ["universe", "date"]).select(
        "symbol", "date", rnd(F.col("pct_change") - F.col("mkt_avg"), 4).alias("rel_momentum")))(S.event_prices(s, d)))

u7, u30 = w(7), w(30)
MARKET = f"""
    SELECT *, {trend('sma_avg_7d', 'sma_avg_30d')} AS trend_7_30 FROM (
    SELECT date, avg_pct, volatility, breadth_pct, {r(f'avg(avg_pct) OVER {u7}', 4)} AS sma_avg_7d,
           {r(f'avg(avg_pct) OVER {u30}', 4)} AS sma_avg_30d, {r(ema_sql('avg_pct', 7), 4)} AS ema_avg_7d,
           {r(ema_sql('avg_pct', 30), 4)} AS ema_avg_30d, {mom('avg_pct', 7, 'universe')} AS mom_avg_7d,
           {z('volatility', u7)} AS vol_zscore_7d, {r(f'avg(breadth_pct) OVER {u7}', 4)} AS breadth_sma_7d,
           {r(ema_sql('breadth_pct', 7), 4)} AS breadth_ema_7d, {mom('breadth_pct', 7, 'universe')} AS breadth_mom_7d,
           {z('avg_pct', u7)} AS signal_strength FROM trade_hist)"""
query("market_indicators", with_("trade_hist", MARKET))(
    lambda s, d: I.market_indicators(trade_hist(s, d)).drop("universe"))

SYMIND = f"""
    SELECT symbol, date, price, pct_change, sma_price_7d, sma_price_30d, ema_price_7d, price_momentum, pct_volatility,
           signal_strength, rel_momentum, {trend('sma_price_7d', 'sma_price_30d')} AS trend_direction FROM (
    SELECT *, {r(f'avg(price) OVER {w7}', 4)} AS sma_price_7d, {r(f'avg(price) OVER {w30}', 4)} AS sma_price_30d,
           {r(ema_sql('price', 7, 'symbol'), 4)} AS ema_price_7d, {mom('price', 7)} AS price_momentum,
           {r(f'stddev_samp(pct_change) OVER {w7}', 4)} AS pct_volatility, {z('pct_change', w7)} AS signal_strength,
           {r('pct_change - avg(pct_change) OVER (PARTITION BY date)', 4)} AS rel_momentum FROM event_prices)"""
query("symbol_indicators", with_("event_prices", SYMIND))(
    lambda s, d: I.symbol_indicators(S.event_prices(s, d)).drop("universe", "company_name", "change"))
query("universe_signals", with_("event_prices", f"""
    SELECT symbol, price, pct_change, trend_direction, signal_strength, rel_momentum, pct_volatility
    FROM ({SYMIND}) WHERE date = (SELECT max(date) FROM event_prices)"""))(
    lambda s, d: I.universe_signals(S.event_prices(s, d)).drop("universe"))

# --- OHLCV indicators ------------------------------------------------------------------------------------------------
CTE["tb"] = (("trade_bars",), "SELECT symbol, date, open, high, low, close, volume FROM trade_bars")


def rsi_sql(n: int, src: str = "tb") -> str:
    a = f"(1.0::DOUBLE / {n})"
    return f"""
        SELECT symbol, date, {r('100 - 100 / (1 + g / nullif(l, 0))', 4)} AS rsi FROM (
        SELECT symbol, date, {ewm_sql('CASE WHEN d > 0 THEN d ELSE 0.0 END', a, 'symbol', n)} AS g,
               {ewm_sql('CASE WHEN d < 0 THEN -d ELSE 0.0 END', a, 'symbol', n)} AS l
        FROM (SELECT symbol, date, close - {lag('close')} AS d FROM {src}) WHERE d IS NOT NULL)"""


query("rsi", with_("tb", f"SELECT b.symbol, b.date, x.rsi FROM tb b LEFT JOIN ({rsi_sql(14)}) x USING (symbol, date)"))(
    lambda s, d: I.rsi(S.trade_bars(s, d).drop("vwap")).select("symbol", "date", "rsi"))


def macd_sql(f: int, s: int, g: int, src: str = "tb") -> str:
    return f"""
        SELECT symbol, date, ema_12, ema_26, macd, macd_signal, {r('macd - macd_signal', 4)} AS macd_hist FROM (
        SELECT *, {r(ema_sql('macd', g, 'symbol'), 4)} AS macd_signal FROM (
        SELECT *, {r('ema_12 - ema_26', 4)} AS macd FROM (
        SELECT symbol, date, {r(ema_sql('close', f, 'symbol'), 4)} AS ema_12,
               {r(ema_sql('close', s, 'symbol'), 4)} AS ema_26 FROM {src})))"""


query("macd", with_("tb", f"SELECT symbol, date, macd, macd_signal, macd_hist FROM ({macd_sql(12, 26, 9)})"))(
    lambda s, d: I.macd(S.trade_bars(s, d)).select("symbol", "date", "macd", "macd_signal", "macd_hist"))


def bb_sql(n: int, src: str = "tb") -> str:
    o = w(n, "symbol")
    width = r("bb_upper - bb_lower", 4)
    return f"""
        SELECT symbol, date, bb_middle, bb_upper, bb_lower, {r(f'{width} / nullif(bb_middle, 0)', 4)} AS bb_width,
               {r(f'(close - bb_lower) / nullif({width}, 0)', 4)} AS bb_pct_b FROM (
        SELECT *, {r('bb_middle + 2.0 * sd', 4)} AS bb_upper, {r('bb_middle - 2.0 * sd', 4)} AS bb_lower FROM (
        SELECT symbol, date, close, {r(f'avg(close) OVER {o}', 4)} AS bb_middle, stddev_samp(close) OVER {o} AS sd
        FROM {src}))"""


query("bollinger", with_("tb", bb_sql(20)))(
    lambda s, d: I.bollinger(S.trade_bars(s, d)).select(
        "symbol", "date", "bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_pct_b"))

TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


def atr_sql(n: int, src: str = "tb") -> str:
    return f"""SELECT symbol, date, {r(ewm_sql('tr', f'(1.0::DOUBLE / {n})', 'symbol', n), 4)} AS atr
               FROM (SELECT symbol, date, {TR} AS tr FROM {src})"""


query("atr", with_("tb", atr_sql(14)))(lambda s, d: I.atr(S.trade_bars(s, d)).select("symbol", "date", "atr"))

w252 = w(252, "symbol")
DRAWDOWN = f"""
    SELECT symbol, date, {r(f'(close - max(close) OVER {w252}) / nullif(max(close) OVER {w252}, 0)', 4)} AS drawdown_pct,
           {r(f'max(close) OVER {w252}', 4)} AS rolling_max FROM tb"""
query("drawdown", with_("tb", DRAWDOWN))(
    lambda s, d: I.drawdown(S.trade_bars(s, d)).select("symbol", "date", "drawdown_pct", "rolling_max"))

CTE["rets"] = (("tb",), f"""SELECT symbol, date, (close - p) / nullif(p, 0) AS r
    FROM (SELECT symbol, date, close, {lag('close')} AS p FROM tb) WHERE (close - p) / nullif(p, 0) IS NOT NULL""")
CTE["regimes"] = (("rets",), f"""
    SELECT t.symbol, CASE WHEN n IS NULL OR n < 63 THEN 1.0::DOUBLE WHEN pr >= 0.80 THEN 0.70::DOUBLE
                          WHEN pr <= 0.20 THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END AS mult
    FROM (SELECT DISTINCT symbol FROM tb) t LEFT JOIN (
        SELECT symbol, max(n) AS n, count_if(h < v)::DOUBLE / nullif(count(h), 0) AS pr FROM (
            SELECT symbol, n, h, stddev_samp(CASE WHEN i > n - 21 THEN r END) OVER (PARTITION BY symbol) AS v FROM (
                SELECT symbol, r, count(*) OVER (PARTITION BY symbol) AS n,
                       row_number() OVER (PARTITION BY symbol ORDER BY date) AS i,
                       CASE WHEN count(r) OVER {w(63, 'symbol')} >= 63 THEN stddev_samp(r) OVER {w(63, 'symbol')} END AS h
                FROM rets)) GROUP BY symbol) q USING (symbol)""")


def pick(lo: object, base: object, hi: object) -> str:
    return f"CASE mult WHEN 0.70 THEN {lo} WHEN 1.35 THEN {hi} ELSE {base} END"


query("regime_windows", with_("regimes", f"""
    SELECT symbol, mult, {pick(10, 14, 19)} AS rsi, {pick(14, 20, 27)} AS bb, {pick(10, 14, 19)} AS atr,
           {pick(8, 12, 16)} AS macd_fast, {pick(18, 26, 35)} AS macd_slow, {pick(6, 9, 12)} AS macd_signal FROM regimes"""))(
    lambda s, d: I.regime_windows(S.trade_bars(s, d)))


def adx_sql(n: int, src: str = "tb") -> str:
    a = f"(1.0::DOUBLE / {n})"
    return f"""
        SELECT b.symbol, b.date, x.adx_14, b.plus_di, b.minus_di FROM (
            SELECT symbol, date, {r('100 * p / nullif(t, 0)', 4)} AS plus_di, {r('100 * m / nullif(t, 0)', 4)} AS minus_di FROM (
            SELECT symbol, date, {ewm_sql('tr', a, 'symbol', n)} AS t,
                   {ewm_sql('CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END', a, 'symbol', n)} AS p,
                   {ewm_sql('CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END', a, 'symbol', n)} AS m
            FROM (SELECT symbol, date, {TR} AS tr, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM {src}))) b
        LEFT JOIN (
            SELECT symbol, date, {r(ewm_sql('dx', a, 'symbol', n), 4)} AS adx_14 FROM (
            SELECT symbol, date, {r('100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)', 4)} AS dx FROM (
            SELECT symbol, date, {r('100 * p / nullif(t, 0)', 4)} AS plus_di, {r('100 * m / nullif(t, 0)', 4)} AS minus_di FROM (
            SELECT symbol, date, {ewm_sql('tr', a, 'symbol', n)} AS t,
                   {ewm_sql('CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END', a, 'symbol', n)} AS p,
                   {ewm_sql('CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END', a, 'symbol', n)} AS m
            FROM (SELECT symbol, date, {TR} AS tr, high - {lag('high')} AS up, {lag('low')} - low AS dn FROM {src}))))
            WHERE dx IS NOT NULL) x USING (symbol, date)"""


query("adx", with_("tb", adx_sql(14)))(
    lambda s, d: I.adx(S.trade_bars(s, d)).select("symbol", "date", "adx_14", "plus_di", "minus_di"))


def stoch_sql(n: int = 14, src: str = "tb") -> str:
    w14, w3 = w(14, "symbol"), w(3, "symbol")
    return f"""
        SELECT symbol, date, stochrsi_k, {r(f'avg(stochrsi_k) OVER {w3}', 4)} AS stochrsi_d FROM (
        SELECT symbol, date, {r(f'avg(raw) OVER {w3}', 4)} AS stochrsi_k FROM (
        SELECT symbol, date, {r(f"(rsi - lo) / nullif({r('hi - lo', 4)}, 0)", 4)} AS raw FROM (
        SELECT b.symbol, b.date, rsi, min(rsi) OVER {w14} AS lo, max(rsi) OVER {w14} AS hi
        FROM (SELECT b.symbol, b.date, x.rsi FROM {src} b LEFT JOIN ({rsi_sql(n, src)}) x USING (symbol, date)) b)))"""


query("stoch_rsi", with_("tb", stoch_sql()))(
    lambda s, d: I.stoch_rsi(S.trade_bars(s, d)).select("symbol", "date", "stochrsi_k", "stochrsi_d"))

# The suite: each regime's symbols go through the same formulas with that regime's windows.
for tag, m, (n_rsi, n_bb, n_atr, nf, ns, ng) in (("lo", 0.70, (10, 14, 10, 8, 18, 6)), ("mid", 1.0, (14, 20, 14, 12, 26, 9)),
                                                 ("hi", 1.35, (19, 27, 19, 16, 35, 12))):
    CTE[f"tb_{tag}"] = (("regimes",), f"SELECT tb.* FROM tb JOIN regimes USING (symbol) WHERE mult = {m}")
    CTE[f"ad_{tag}"] = ((f"tb_{tag}",), f"""
        SELECT symbol, date, {m}::DOUBLE AS vol_regime_mult, m.ema_12, m.ema_26, m.macd, m.macd_signal, m.macd_hist,
               b.bb_middle, b.bb_upper, b.bb_lower, b.bb_width, b.bb_pct_b, a.atr AS atr_14, x.rsi AS rsi_14
        FROM ({macd_sql(nf, ns, ng, f'tb_{tag}')}) m JOIN ({bb_sql(n_bb, f'tb_{tag}')}) b USING (symbol, date)
        JOIN ({atr_sql(n_atr, f'tb_{tag}')}) a USING (symbol, date)
        LEFT JOIN ({rsi_sql(n_rsi, f'tb_{tag}')}) x USING (symbol, date)""")
CTE["suite"] = (("ad_lo", "ad_mid", "ad_hi"), f"""
    SELECT f.symbol, f.date, f.open, f.high, f.low, f.close, f.volume, f.returns_pct, f.sma_20, f.sma_50, f.volatility_21,
           f.momentum_10, f.signal_strength, f.volume_sma_20, ad.* EXCLUDE (symbol, date), dd.drawdown_pct, dd.rolling_max,
           adx.adx_14, adx.plus_di, adx.minus_di, st.stochrsi_k, st.stochrsi_d
    FROM (SELECT *, {r(f'stddev_samp(returns_pct) OVER {w(21, "symbol")}', 4)} AS volatility_21,
                 {z('returns_pct', w7)} AS signal_strength FROM (
          SELECT *, {r(f"(close - {lag('close')}) / nullif({lag('close')}, 0) * 100", 4)} AS returns_pct,
                 {r(f'avg(close) OVER {w20}', 4)} AS sma_20, {r(f'avg(close) OVER {w50}', 4)} AS sma_50,
                 {mom('close', 10)} AS momentum_10, {r(f'avg(volume) OVER {w20}', 4)} AS volume_sma_20 FROM tb)) f
    JOIN (SELECT * FROM ad_lo UNION ALL SELECT * FROM ad_mid UNION ALL SELECT * FROM ad_hi) ad USING (symbol, date)
    JOIN ({DRAWDOWN}) dd USING (symbol, date) JOIN ({adx_sql(14)}) adx USING (symbol, date)
    JOIN ({stoch_sql()}) st USING (symbol, date)""")


def ohlcv(spark, sf):
    return S.trade_bars(spark, sf).drop("vwap")


query("indicator_suite", with_("suite", "SELECT * FROM suite"))(lambda s, d: I.indicator_suite(ohlcv(s, d), complete=True))

# --- cleaning and projections ------------------------------------------------------------------------------------------
query("price_status_tier", with_("event_prices", """
    SELECT symbol, date, CASE WHEN change > 0 THEN 'Gainer' WHEN change < 0 THEN 'Loser' ELSE 'Flat' END AS status,
           abs(change) AS abs_change, CASE WHEN price > 0 AND price <= 10 THEN '<$10' WHEN price > 10 AND price <= 25 THEN '$10-25'
           WHEN price > 25 AND price <= 50 THEN '$25-50' WHEN price > 50 AND price <= 100 THEN '$50-100'
           WHEN price > 100 AND price <= 200 THEN '$100-200' WHEN price > 200 AND price <= 9999 THEN '>$200' END AS price_tier
    FROM event_prices"""))(
    lambda s, d: S.event_prices(s, d).select(
        "symbol", "date", ladders.status(F.col("change")).alias("status"), F.abs("change").alias("abs_change"),
        ladders.price_tier(F.col("price")).alias("price_tier")))


query("pct_recompute", with_("event_prices", f"""
    SELECT symbol, date, CASE WHEN abs(change) >= 0.01 THEN {r('change / nullif(price - change, 0) * 100', 2)}
                              ELSE pct_change END AS pct_change FROM event_prices"""))(
    lambda s, d: pct_recompute(S.event_prices(s, d)).select("symbol", "date", "pct_change"))
query("pct_discrepancy", with_("event_prices", f"""
    SELECT symbol, date, {r('d', 6)} AS discrepancy FROM (SELECT symbol, date,
           abs({r('change', 2)} / nullif(price - {r('change', 2)}, 0) * 100 - pct_change) AS d FROM event_prices)
    WHERE d > 0.1"""))(
    lambda s, d: pct_discrepancy(S.event_prices(s, d).withColumn("change", rnd(F.col("change"), 2)))
    .select("symbol", "date", rnd(F.col("discrepancy"), 6).alias("discrepancy")))


def from_open(spark, sf):
    """Prices whose percent change was taken from the day's open, while ``change`` is against the close before."""
    move = (F.col("close") - F.col("open")) / F.nullif(F.col("open"), F.lit(0.0)) * 100
    return S.event_prices(spark, sf).drop("pct_change").join(
        S.event_bars(spark, sf).select("symbol", "date", move.alias("pct_change")), ["symbol", "date"])


query("pct_discrepancy_from_open", with_("event_prices event_bars", f"""
    SELECT symbol, date, {r('d', 6)} AS discrepancy FROM (
        SELECT p.symbol, p.date, abs(p.change / nullif(p.price - p.change, 0) * 100 - (b.close - b.open) / nullif(b.open, 0) * 100) AS d
        FROM event_prices p JOIN event_bars b USING (symbol, date)) WHERE d > 0.1"""))(
    lambda s, d: pct_discrepancy(from_open(s, d)).select("symbol", "date", rnd(F.col("discrepancy"), 6).alias("discrepancy")))


def messy_bars(spark, sf):
    """Bars plus damaged copies derived from them: inverted high/low, negative volume, text prices, duplicate days."""
    b = S.event_bars(spark, sf)
    n = F.dayofmonth("date")
    txt = [F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")]
    orig = b.select("symbol", "date", *txt, F.lit(0).alias("seq"))
    bad = b.where(n % 5 == 0).select(
        "symbol", "date", F.col("open").cast("string").alias("open"), F.col("low").cast("string").alias("high"),
        F.col("high").cast("string").alias("low"),
        F.when(n == 10, F.lit("n/a")).otherwise(F.col("close").cast("string")).alias("close"),
        (-F.col("volume")).cast("string").alias("volume"), F.lit(1).alias("seq"))
    return orig.unionByName(bad)


CTE["clean"] = (("event_bars",), """
    SELECT symbol, date, open, high, low, close, CASE WHEN day(date) % 5 = 0 AND day(date) <> 10 THEN 0.0::DOUBLE
           ELSE volume END AS volume FROM event_bars""")
query("clean_bars", with_("clean", "SELECT * FROM clean"))(lambda s, d: P.clean_bars(messy_bars(s, d), ["seq"]))
RETURNS = f"""
    SELECT symbol, date, {r('(close - p) / nullif(p, 0) * 100', 4)} AS returns_pct,
           {r('CASE WHEN close / nullif(p, 0) > 0 THEN ln(close / p) END', 6)} AS log_returns,
           {r('(open - p) / nullif(p, 0) * 100', 4)} AS gap_pct, {r('(high - low) / nullif(p, 0) * 100', 4)} AS intraday_range_pct
    FROM (SELECT *, {lag('close')} AS p FROM {{src}})"""
query("bar_returns", with_("event_bars", RETURNS.format(src="event_bars")))(
    lambda s, d: P.bar_returns(S.event_bars(s, d)).drop("open", "high", "low", "close", "volume"))
OUTLIER = f"""coalesce(abs({r(f'(returns_pct - avg(returns_pct) OVER {w30}) / nullif(stddev_samp(returns_pct) OVER {w30}, 0)', 9)}) > 3
              AND count(returns_pct) OVER {w30} >= 5, false) AS returns_pct_outlier"""
query("outlier_flag", with_("event_bars", f"SELECT symbol, date, {OUTLIER} FROM ({RETURNS.format(src='event_bars')})"))(
    lambda s, d: P.outlier_flag(P.bar_returns(S.event_bars(s, d))).select("symbol", "date", "returns_pct_outlier"))
query("preprocess_bars", with_("clean", f"""
    SELECT c.*, x.returns_pct, x.log_returns, x.gap_pct, x.intraday_range_pct, x.returns_pct_outlier FROM clean c
    JOIN (SELECT *, {OUTLIER} FROM ({RETURNS.format(src='clean')})) x USING (symbol, date)"""))(
    lambda s, d: P.preprocess_bars(messy_bars(s, d), ["seq"]))
query("split_detect", with_("tb", f"""
    SELECT symbol, date, {r('q', 6)} AS ratio FROM (SELECT symbol, date, close / nullif({lag('close')}, 0) AS q FROM tb)
    WHERE q < 0.60 OR q > 1.67"""))(lambda s, d: P.split_detect(ohlcv(s, d)))
query("gap_fill", with_("event_bars", """
    , grid AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date
               FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM event_bars GROUP BY symbol)),
    j AS (SELECT g.symbol, g.date, b.open, b.high, b.low, b.close, b.volume,
                 count(b.close) OVER (PARTITION BY g.symbol ORDER BY g.date) AS gid
          FROM (SELECT * FROM grid WHERE isodow(date) < 6) g LEFT JOIN event_bars b USING (symbol, date)),
    k AS (SELECT *, close IS NULL AND count_if(close IS NULL) OVER (PARTITION BY symbol, gid) <= 3 AS filled FROM j)
    SELECT symbol, date,
           CASE WHEN filled THEN last_value(open IGNORE NULLS) OVER o ELSE open END AS open,
           CASE WHEN filled THEN last_value(high IGNORE NULLS) OVER o ELSE high END AS high,
           CASE WHEN filled THEN last_value(low IGNORE NULLS) OVER o ELSE low END AS low,
           CASE WHEN filled THEN last_value(close IGNORE NULLS) OVER o ELSE close END AS close,
           CASE WHEN filled THEN 0.0::DOUBLE ELSE volume END AS volume, filled
    FROM k WINDOW o AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
      .replace(")\n\n    , grid", "),\n grid"))(lambda s, d: P.gap_fill(S.event_bars(s, d)))

for how, expr in (("zscore", "CASE WHEN sd = 0 THEN price - m ELSE (price - m) / sd END"),
                  ("minmax", "CASE WHEN hi = lo THEN 0.0::DOUBLE ELSE (price - lo) / (hi - lo) END"),
                  ("robust", "CASE WHEN q3 - q1 = 0 THEN price - q2 ELSE (price - q2) / (q3 - q1) END")):
    query(f"normalise_{how}", with_("event_prices", f"""
        SELECT symbol, date, price, {r(expr, 6)} AS price_{how} FROM event_prices JOIN (
        SELECT symbol, avg(price) AS m, stddev_samp(price) AS sd, min(price) AS lo, max(price) AS hi,
               quantile_cont(price, 0.25) AS q1, median(price) AS q2, quantile_cont(price, 0.75) AS q3
        FROM event_prices GROUP BY symbol) USING (symbol)"""))(
        lambda s, d, how=how: P.normalise(S.event_prices(s, d).select("symbol", "date", "price"), "price", how))

query("cum_return", with_("event_bars", f"""
    SELECT symbol, date, {r('(close / nullif(f, 0) - 1) * 100', 2)} AS cum_ret FROM (
    SELECT *, first_value(close) OVER (PARTITION BY symbol ORDER BY date) AS f, count(*) OVER (PARTITION BY symbol) AS n
    FROM event_bars) WHERE n >= 20"""))(lambda s, d: I.cum_return(S.event_bars(s, d)))

BACKFILL_DAY = dt.date(2024, 1, 17)
query("backfill_day", with_("event_bars", f"""
    SELECT date, symbol, symbol AS company_name, {r('close', 4)} AS price, {r('close - p', 4)} AS change,
           {r(f"{r('close - p', 4)} / p * 100", 2)} AS pct_change
    FROM (SELECT *, {lag('close')} AS p FROM event_bars) WHERE date = DATE '{BACKFILL_DAY}' AND p <> 0"""))(
    lambda s, d: (lambda b: I.backfill_day(b, b.groupBy("symbol").agg(F.min_by("symbol", "date").alias("company_name")),
                                           F.lit(BACKFILL_DAY)))(S.event_bars(s, d)))

query("recent_context", with_("event_hist", """
    SELECT date, metric, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY date DESC) AS rn FROM (
        SELECT date, 'avg_pct' AS metric, avg_pct AS value FROM event_hist UNION ALL
        SELECT date, 'volatility', volatility FROM event_hist UNION ALL SELECT date, 'breadth_pct', breadth_pct FROM event_hist))
    WHERE rn <= 14"""))(
    lambda s, d: I.recent_context(
        event_hist(s, d).unpivot(["date"], ["avg_pct", "volatility", "breadth_pct"], "metric", "value"), ["metric"]))


def refreshed_indicators(spark, sf):
    """All indicator rows of the symbols whose stored days lag behind, from cleaned bars and without the completeness promise."""
    bars = ohlcv(spark, sf)
    stored = bars.where(F.col("date") < F.lit(dt.date(1998, 1, 5))).select("symbol", "date")
    fresh = I.run_indicators(bars.withColumn("seq", F.lit(0)), ["seq"], stored)
    return fresh.select(*I.indicator_suite(bars, complete=True).columns)


query("indicators_refresh", with_("suite", "SELECT * FROM suite"))(refreshed_indicators)


LATE_WEEK = dt.date(1999, 6, 7)


def late_bar(spark, sf):
    """The stored bars lack one week of some symbols; once it is there, only the blocks from that week's on are read and run again."""
    base = work_dir(spark, "resume")
    bars = ohlcv(spark, sf).withColumn("block", RS.yearly(F.col("date")))
    missing = (F.col("date") == F.lit(LATE_WEEK)) & (F.col("symbol") <= "NATION_2")
    bars.write.partitionBy("block").parquet(f"{base}/bars")
    now = spark.read.schema(bars.schema).parquet(f"{base}/bars")

    def keep(run):
        run.write.parquet(f"{base}/run")
        return spark.read.schema(run.schema).parquet(f"{base}/run")

    indicators, states = RS.full_run(now.where(~missing).drop("block"), keep=keep)
    indicators.write.partitionBy("block").parquet(f"{base}/indicators")
    states.write.partitionBy("block").parquet(f"{base}/snapshots")
    stored = spark.read.schema(indicators.schema).parquet(f"{base}/indicators")
    snaps = spark.read.schema(states.schema).parquet(f"{base}/snapshots")
    fresh, _ = RS.rerun(now, snaps, now.where(missing).select("symbol", "date"))
    touched = fresh.groupBy("symbol").agg(F.min("block").alias("_from"))
    kept = stored.join(touched, "symbol", "left").where(F.col("_from").isNull() | (F.col("block") < F.col("_from"))).drop("_from")
    return kept.unionByName(fresh.select(*kept.columns)).drop("block")


query("indicators_after_late_bar", with_("suite", "SELECT * FROM suite"))(late_bar)
