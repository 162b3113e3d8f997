"""Market-level queries: daily cross-section, rolling intelligence, movers, streaks, cycles, time-series views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import daily as D
from tickloom.plans.registry import query
from tickloom.plans.sqlviews import HIST_COLS, ROLL_COLS, r, skew_sql, ema_sql, w, with_
from tickloom.sources import sample as S


def event_hist(spark, sf):
    return D.daily_breadth(S.event_prices(spark, sf))


def trade_hist(spark, sf):
    return D.daily_breadth(S.trade_prices(spark, sf))


def trade_roll(spark, sf):
    return D.rolling_intelligence(trade_hist(spark, sf))


query("daily_breadth", with_("event_hist", f"SELECT {HIST_COLS} FROM event_hist"))(
    lambda s, d: event_hist(s, d).drop("universe"))
query("daily_breadth_weekly", with_("trade_hist", f"SELECT {HIST_COLS} FROM trade_hist"))(
    lambda s, d: trade_hist(s, d).drop("universe"))

BAR_AGG = f"""
    SELECT date, n_gainers, n_losers, n_flat, {r('avg_pct', 4)} AS avg_pct, {r('coalesce(volatility, 0.0)', 4)} AS volatility,
           coalesce(skew_pct, 0.0) AS skew_pct, coalesce(kurt_pct, 0.0) AS kurt_pct, breadth_pct, regime,
           '' AS best_stock, 0.0::DOUBLE AS best_pct, '' AS worst_stock, 0.0::DOUBLE AS worst_pct,
           sign({r('avg_pct', 4)})::DOUBLE AS streak_sign
    FROM {{hist}} WHERE date IN (SELECT date FROM {{prices}} GROUP BY date HAVING count(pct_change) >= 10)"""

query("bar_daily_aggregates", with_("event_hist", BAR_AGG.format(hist="event_hist", prices="event_prices")))(
    lambda s, d: D.bar_daily_aggregates(S.event_bars(s, d)).drop("universe"))
query("rolling_intelligence", with_("trade_roll", f"SELECT date, {ROLL_COLS} FROM trade_roll"))(
    lambda s, d: trade_roll(s, d).select("date", *[c.strip() for c in ROLL_COLS.split(",")]))
query("rolling_intelligence_daily", with_("event_roll", f"SELECT date, {ROLL_COLS} FROM event_roll"))(
    lambda s, d: D.rolling_intelligence(event_hist(s, d)).select("date", *[c.strip() for c in ROLL_COLS.split(",")]))
query("tail_risk", with_("trade_roll", "SELECT date, var_5, cvar_5, tail_ratio FROM trade_roll"))(
    lambda s, d: trade_roll(s, d).select("date", "var_5", "cvar_5", "tail_ratio"))
query("adaptive_regime", with_("trade_roll", "SELECT date, breadth_pct, regime_adaptive, vol_pct_rank FROM trade_roll"))(
    lambda s, d: trade_roll(s, d).select("date", "breadth_pct", "regime_adaptive", "vol_pct_rank"))


def frequent(sign: str, order: str) -> str:
    return with_("event_prices", f"""
        SELECT symbol, n AS appearances, {r('n / days * 100', 1)} AS pct_days
        FROM (SELECT symbol, count(*) AS n, (SELECT count(DISTINCT date) FROM event_prices) AS days
              FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pct_change {order}, symbol) AS rn
                    FROM event_prices WHERE pct_change {sign} 0) WHERE rn <= 10 GROUP BY symbol)
        ORDER BY n DESC, symbol LIMIT 15""")


query("frequent_movers", frequent(">", "DESC"))(
    lambda s, d: D.frequent_movers(S.event_prices(s, d)).drop("universe"))
query("frequent_losers", frequent("<", "ASC"))(
    lambda s, d: D.frequent_losers(S.event_prices(s, d)).drop("universe"))

query("coverage_semi", with_("event_prices", """
    SELECT universe, date, symbol, price, change, pct_change FROM event_prices WHERE symbol IN (
        SELECT symbol FROM event_prices GROUP BY symbol HAVING count(DISTINCT date) >= greatest(1, floor(
            (SELECT count(DISTINCT date) FROM event_prices) * 0.5)))"""))(
    lambda s, d: (lambda p: p.join(D.covered_symbols(p), ["universe", "symbol"], "left_semi")
                  .drop("company_name"))(S.event_prices(s, d)))

query("cumulative_performance", with_("trade_prices", f"""
    , cum AS (SELECT symbol, date, {r('(product(1 + pct_change / 100) OVER (PARTITION BY symbol ORDER BY date) - 1) * 100', 4)} AS cum_pct
              FROM trade_prices WHERE symbol IN (SELECT symbol FROM trade_prices GROUP BY symbol HAVING count(DISTINCT date) >=
                  greatest(1, floor((SELECT count(DISTINCT date) FROM trade_prices) * 0.5)))),
    fin AS (SELECT symbol, last(cum_pct ORDER BY date) AS f FROM cum GROUP BY symbol)
    SELECT * FROM cum WHERE symbol IN (SELECT symbol FROM fin ORDER BY f DESC, symbol LIMIT 5)
        OR symbol IN (SELECT symbol FROM fin ORDER BY f, symbol DESC LIMIT 5)""").replace(")\n\n    , cum", "),\n cum"))(
    lambda s, d: D.cumulative_performance(S.trade_prices(s, d), top=5).drop("universe"))

query("extreme_sessions", with_("trade_hist", """
    , k AS (SELECT least(5, count(*) // 2) AS side FROM trade_hist),
    weak AS (SELECT date, avg_pct FROM trade_hist ORDER BY avg_pct, date LIMIT (SELECT side FROM k)),
    strong AS (SELECT date, avg_pct FROM trade_hist WHERE date NOT IN (SELECT date FROM weak)
               ORDER BY avg_pct DESC, date LIMIT (SELECT side FROM k))
    SELECT date, avg_pct, CASE WHEN avg_pct >= 0 THEN 'Bullish' ELSE 'Bearish' END AS direction
    FROM (SELECT * FROM weak UNION ALL SELECT * FROM strong)""").replace(")\n\n    , k", "),\n k"))(
    lambda s, d: D.extreme_sessions(trade_hist(s, d)).select("date", "avg_pct", "direction"))


def islands(src: str, sign: str) -> str:
    """Islands by the difference of two row numbers (the Spark side uses a change flag)."""
    return f"""
        SELECT sgn, rn - row_number() OVER (PARTITION BY sgn ORDER BY date) AS grp, date, avg_pct
        FROM (SELECT date, avg_pct, {sign} AS sgn, row_number() OVER (ORDER BY date) AS rn FROM {src}
              WHERE {sign} IS NOT NULL)"""


query("streaks", with_("trade_hist", f"""
    SELECT min(date) AS start_date, max(date) AS end_date, count(*) AS length,
           CASE WHEN sgn > 0 THEN 'Bullish' ELSE 'Bearish' END AS direction, {r('avg(avg_pct)', 4)} AS avg_pct
    FROM ({islands('trade_hist', 'streak_sign')}) WHERE sgn <> 0 GROUP BY sgn, grp"""))(
    lambda s, d: D.streaks(trade_hist(s, d)).drop("universe"))
CYCLES = f"""
    SELECT min(date) AS start_date, max(date) AS end_date, count(*) AS length_days,
           CASE WHEN sgn > 0 THEN 'Bull' ELSE 'Bear' END AS direction, {r('avg(avg_pct)', 4)} AS avg_return,
           {r('CASE WHEN sgn > 0 THEN max(avg_pct) ELSE min(avg_pct) END', 4)} AS peak_return
    FROM ({islands('trade_roll', 'sign(rolling_avg_7d)')}) WHERE sgn <> 0 GROUP BY sgn, grp"""
query("market_cycles", with_("trade_roll", CYCLES))(lambda s, d: D.market_cycles(trade_roll(s, d)).drop("universe"))
query("baseline_vol", with_("event_hist", f"""
    SELECT count(*) AS n_days, max(volatility) FILTER (date = m) AS latest_vol,
           {r('avg(volatility) FILTER (date < m)', 6)} AS baseline_vol, count(*) >= 2 AS has_history
    FROM event_hist, (SELECT max(date) AS m FROM event_hist)"""))(
    lambda s, d: D.baseline_vol(event_hist(s, d)).drop("universe"))

c7 = "(PARTITION BY universe ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
DECOMP = f"""
    SELECT date, {r('avg_pct', 4)} AS original, {r(f'avg(avg_pct) OVER {c7}', 4)} AS trend,
           {r(f'avg_pct - avg(avg_pct) OVER {c7}', 4)} AS residual, {r(f'avg(avg_pct) OVER {w(7)}', 4)} AS smoothed
    FROM trade_hist"""
query("decompose", with_("trade_hist", DECOMP))(
    lambda s, d: D.decompose(trade_hist(s, d), "avg_pct", 7).drop("universe"))

ROLLSTATS = f"""
    SELECT *, {r('max - min', 4)} AS "range" FROM (
    SELECT date, {r(f'avg(avg_pct) OVER {w(7)}', 4)} AS mean, {r(f'stddev_samp(avg_pct) OVER {w(7)}', 4)} AS std,
           {r(f'min(avg_pct) OVER {w(7)}', 4)} AS min, {r(f'max(avg_pct) OVER {w(7)}', 4)} AS max,
           {r(skew_sql('avg_pct', w(7)), 4)} AS skew,
           {r(f'avg(CASE WHEN avg_pct > 0 THEN 1.0::DOUBLE ELSE 0.0 END) OVER {w(7)} * 100', 2)} AS pct_positive
    FROM trade_hist)"""
query("rolling_stats", with_("trade_hist", ROLLSTATS))(
    lambda s, d: D.rolling_stats(trade_hist(s, d), "avg_pct", 7).drop("universe"))

CROSS = f"""
    SELECT date, {r('a', 4)} AS short_ma, {r('b', 4)} AS long_ma, {r('g', 4)} AS gap,
           CASE WHEN g > 0.005 AND pg <= 0.005 THEN 'Bullish' WHEN g < -0.005 AND pg >= -0.005 THEN 'Bearish' ELSE '' END AS crossover
    FROM (SELECT *, lag(g) OVER (ORDER BY date) AS pg FROM (
          SELECT *, {r('(a - b) / nullif(abs(b), 0)', 12)} AS g FROM (
          SELECT date, avg(avg_pct) OVER {w(7)} AS a, avg(avg_pct) OVER {w(30)} AS b FROM trade_hist)))"""
query("ma_crossover", with_("trade_hist", CROSS))(
    lambda s, d: D.ma_crossover(trade_hist(s, d), "avg_pct").drop("universe"))

query("rolling_corr", with_("trade_hist", f"""
    SELECT date, CASE WHEN count(*) FILTER (avg_pct IS NOT NULL AND volatility IS NOT NULL) OVER {w(7)} >= 3
                      THEN {r(f'corr(avg_pct, volatility) OVER {w(7)}', 4)} END AS corr FROM trade_hist"""))(
    lambda s, d: D.rolling_corr(trade_hist(s, d), "avg_pct", "volatility", 7).select("date", "corr"))

BTREND = f"""
    SELECT date, breadth_pct, breadth_sma_7d, breadth_ema_7d, net_breadth,
           CASE WHEN {r('breadth_sma_7d - p', 6)} > 1.0 THEN 'Expanding' WHEN {r('breadth_sma_7d - p', 6)} < -1.0
                THEN 'Contracting' ELSE 'Stable' END AS breadth_trend
    FROM (SELECT *, lag(breadth_sma_7d) OVER (ORDER BY date) AS p FROM (
          SELECT universe, date, breadth_pct, {r(f'avg(breadth_pct) OVER {w(7)}', 2)} AS breadth_sma_7d,
                 {r(ema_sql('breadth_pct', 7), 2)} AS breadth_ema_7d, n_gainers - n_losers AS net_breadth
          FROM trade_hist))"""
query("breadth_trend", with_("trade_hist", BTREND))(lambda s, d: D.breadth_trend(trade_hist(s, d)).drop("universe"))

query("current_state", with_("trade_roll", f"""
    SELECT c.direction AS cycle_direction, c.length_days AS cycle_days, c.avg_return AS cycle_return,
           coalesce(x.crossover, 'None yet') AS last_cross, x.date AS last_cross_date, b.breadth_trend, d.residual
    FROM (SELECT * FROM ({CYCLES}) ORDER BY start_date DESC LIMIT 1) c,
         (SELECT * FROM ({BTREND}) ORDER BY date DESC LIMIT 1) b, (SELECT * FROM ({DECOMP}) ORDER BY date DESC LIMIT 1) d
    LEFT JOIN (SELECT * FROM ({CROSS}) WHERE crossover <> '' ORDER BY date DESC LIMIT 1) x ON true"""))(
    lambda s, d: D.current_state(trade_roll(s, d)).drop("universe"))

query("heatmap_matrix", with_("event_hist", """
    SELECT date, 'breadth_pct' AS metric, breadth_pct AS value FROM event_hist UNION ALL
    SELECT date, 'avg_pct', avg_pct FROM event_hist UNION ALL SELECT date, 'volatility', volatility FROM event_hist"""))(
    lambda s, d: event_hist(s, d).unpivot(["date"], ["breadth_pct", "avg_pct", "volatility"], "metric", "value"))
