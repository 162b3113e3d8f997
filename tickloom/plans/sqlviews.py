"""DuckDB building blocks for the SQL twins: the same views, written independently of the Spark code."""

from __future__ import annotations

from tickloom.plans.lexicon_sql import LEXICON_VALUES


def r(x: str, n: int) -> str:
    """Half-even rounding with the tie decided by the decimal value."""
    return f"(round_even(round_even(({x}) * 1e{n + 6}, 0) / 1e6, 0) / 1e{n} + 0.0)"


def w(rows: int, by: str = "universe") -> str:
    return f"(PARTITION BY {by} ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def wall(by: str = "universe") -> str:
    return f"(PARTITION BY {by} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def skew_sql(x: str, over: str = "") -> str:
    o = f" OVER {over}" if over else ""
    return (f"CASE WHEN count({x}){o} < 3 THEN NULL WHEN stddev_samp({x}){o} = 0 THEN 0.0 "
            f"ELSE skewness({x}){o} END")


def kurt_sql(x: str) -> str:
    return (f"CASE WHEN count({x}) < 4 THEN NULL WHEN stddev_samp({x}) = 0 THEN 0.0 ELSE kurtosis({x}) END")


def ema_sql(x: str, span: int, by: str = "universe") -> str:
    """Exact recursion over the NULL-free ordered list; α = 2 / (span + 1)."""
    return ewm_sql(x, f"(2.0::DOUBLE / {span + 1})", by)


def ewm_sql(x: str, alpha: str, by: str, min_rows: int = 1) -> str:
    core = (f"list_reduce(list(({x})::DOUBLE) OVER (PARTITION BY {by} ORDER BY date), "
            f"lambda a, v: {alpha} * v + (1 - {alpha}) * a)")
    if min_rows == 1:
        return core
    return f"CASE WHEN count({x}) OVER (PARTITION BY {by} ORDER BY date) >= {min_rows} THEN {core} END"


#: ``U`` and the id with at least four digits.
SYMBOL = ("'U' || CASE WHEN length(CAST(user_id AS VARCHAR)) < 4 THEN lpad(CAST(user_id AS VARCHAR), 4, '0') "
          "ELSE CAST(user_id AS VARCHAR) END")

CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "event_bars": ((), f"""
        SELECT {SYMBOL} AS symbol, CAST(ts AS DATE) AS date,
               first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
               last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
        FROM events GROUP BY 1, 2"""),
    "event_prices": (("event_bars",), """
        SELECT 'all' AS universe, date, symbol, symbol AS company_name, close AS price, close - p AS change,
               (close - p) / nullif(p, 0) * 100 AS pct_change
        FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM event_bars) WHERE p IS NOT NULL"""),
    "trade_bars": ((), f"""
        SELECT symbol, date, first(tp ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, tp) AS open,
               max(tp) AS high, min(tp) AS low,
               last(tp ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, tp) AS close,
               sum(l_quantity)::DOUBLE AS volume, {r('sum(l_extendedprice) / nullif(sum(l_quantity), 0)', 6)} AS vwap
        FROM (SELECT n_name AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
                     l_extendedprice / nullif(l_quantity, 0) AS tp, lineitem.*
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
        GROUP BY 1, 2"""),
    "trade_prices": (("trade_bars",), """
        SELECT 'all' AS universe, date, symbol, symbol AS company_name, vwap AS price, vwap - p AS change,
               (vwap - p) / nullif(p, 0) * 100 AS pct_change
        FROM (SELECT *, lag(vwap) OVER (PARTITION BY symbol ORDER BY date) AS p FROM trade_bars) WHERE p IS NOT NULL"""),
    "lexicon": ((), f"SELECT * FROM (VALUES {LEXICON_VALUES}) AS t(token, weight)"),
    "raw_headlines": ((), """
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, n_name AS symbol,
               DATE '1995-01-02' + CAST(7 * ((doc_id // 25) % 357) AS INTEGER) AS date, trim(parts[i]) AS headline
        FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
              FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
        JOIN nation ON n_nationkey = doc_id % 25 WHERE length(trim(parts[i])) > 3"""),
    "headlines": (("raw_headlines", "lexicon"), f"""
        SELECT h.symbol, h.date, h.doc_id, h.line, h.headline, {r('coalesce(s.score, 0.0)', 4)} AS score
        FROM raw_headlines h LEFT JOIN (
            SELECT doc_id, line, avg(weight) AS score
            FROM (SELECT doc_id, line, unnest(regexp_split_to_array(lower(headline), '[^a-zà-ÿ]+')) AS token
                  FROM raw_headlines) JOIN lexicon USING (token) GROUP BY doc_id, line) s USING (doc_id, line)"""),
    "sentiment": (("headlines",), f"""
        SELECT date, symbol, {r('m', 4)} AS sentiment_score,
               CASE WHEN {r('m', 9)} >= 0.05 THEN 'Bullish' WHEN {r('m', 9)} <= -0.05 THEN 'Bearish'
                    ELSE 'Neutral' END AS sentiment_label, n AS headlines_used,
               first(headline ORDER BY {r('abs(score - m)', 9)}, doc_id, line) AS top_headline
        FROM (SELECT *, avg(score) OVER (PARTITION BY symbol, date) AS m,
                     count(*) OVER (PARTITION BY symbol, date) AS n FROM headlines)
        GROUP BY date, symbol, m, n"""),
    "daily_sent": (("sentiment",), """
        SELECT 'all' AS universe, date, avg(sentiment_score) AS avg_score FROM sentiment
        WHERE sentiment_score IS NOT NULL GROUP BY date"""),
}


def daily_cte(prices: str) -> str:
    breadth = r("count_if(change > 0) / (count_if(change > 0) + count_if(change < 0) + count_if(change = 0)) * 100", 2)
    return f"""
        SELECT *, CASE WHEN breadth_pct >= 60 THEN 'Bullish' WHEN breadth_pct <= 40 THEN 'Bearish' ELSE 'Mixed' END AS regime,
               sign(avg_pct)::DOUBLE AS streak_sign
        FROM (SELECT universe, date, count_if(change > 0)::BIGINT AS n_gainers, count_if(change < 0)::BIGINT AS n_losers,
                     count_if(change = 0)::BIGINT AS n_flat, {r('avg(pct_change)', 6)} AS avg_pct,
                     {r('stddev_samp(pct_change)', 6)} AS volatility,
                     {r(skew_sql('pct_change'), 4)} AS skew_pct, {r(kurt_sql('pct_change'), 4)} AS kurt_pct,
                     {breadth} AS breadth_pct,
                     first(symbol ORDER BY pct_change DESC, symbol) FILTER (pct_change IS NOT NULL) AS best_stock,
                     max(pct_change) AS best_pct,
                     first(symbol ORDER BY pct_change, symbol) FILTER (pct_change IS NOT NULL) AS worst_stock,
                     min(pct_change) AS worst_pct
              FROM {prices} GROUP BY universe, date)"""


CTE["event_hist"] = (("event_prices",), daily_cte("event_prices"))
CTE["trade_hist"] = (("trade_prices",), daily_cte("trade_prices"))


def roll_cte(hist: str) -> str:
    w7, w30, w63 = w(7), w(30), w(63)
    p05 = f"CASE WHEN count(avg_pct) OVER {w30} >= 10 THEN quantile_cont(avg_pct, 0.05) OVER {w30} END"
    p95 = f"CASE WHEN count(avg_pct) OVER {w30} >= 10 THEN quantile_cont(avg_pct, 0.95) OVER {w30} END"
    return f"""
        SELECT *, sma_avg_7d AS rolling_avg_7d, sma_avg_30d AS rolling_avg_30d,
               {r('(avg_pct - sma_avg_7d) / nullif(sd7, 0)', 4)} AS rolling_signal_7d,
               CASE WHEN volatility / nullif(rolling_vol_30d, 0) >= 1.5 THEN 'Elevated'
                    WHEN volatility / nullif(rolling_vol_30d, 0) >= 1.1 THEN 'Slightly High'
                    WHEN volatility / nullif(rolling_vol_30d, 0) >= 0.9 THEN 'Normal' ELSE 'Suppressed' END AS volatility_regime,
               {r('p05', 4)} AS var_5, {r('p95 / nullif(abs(p05), 0)', 4)} AS tail_ratio,
               {r('CASE WHEN p05 IS NOT NULL THEN list_avg(list_filter(l30, lambda v: v <= p05)) END', 4)} AS cvar_5,
               {r('CASE WHEN nv30 >= 5 THEN len(list_filter(v30, lambda v: v <= volatility)) / len(v30) END', 4)} AS vol_pct_rank,
               CASE WHEN n63 >= 10 AND len(list_filter(b63, lambda v: v <= breadth_pct)) / n63 >= 0.65 THEN 'Bullish'
                    WHEN n63 >= 10 AND len(list_filter(b63, lambda v: v <= breadth_pct)) / n63 <= 0.35 THEN 'Bearish'
                    ELSE 'Mixed' END AS regime_adaptive
        FROM (SELECT *, {r(f'avg(avg_pct) OVER {w7}', 4)} AS sma_avg_7d, {r(f'avg(avg_pct) OVER {w30}', 4)} AS sma_avg_30d,
                     {r(f'avg(volatility) OVER {w7}', 4)} AS rolling_vol_7d,
                     {r(f'avg(volatility) OVER {w30}', 4)} AS rolling_vol_30d,
                     {r(ema_sql('avg_pct', 7), 4)} AS ema_avg_7d, {r(ema_sql('avg_pct', 30), 4)} AS ema_avg_30d,
                     {r(f'avg(CASE WHEN avg_pct > 0 THEN 1.0::DOUBLE ELSE 0.0 END) OVER {w7} * 100', 2)} AS trend_persistence_7d,
                     {r(f'avg(CASE WHEN breadth_pct - 50 > 0 THEN 1.0::DOUBLE ELSE 0.0 END) OVER {w7} * 100', 2)}
                         AS breadth_trend_persistence_7d,
                     stddev_samp(avg_pct) OVER {w7} AS sd7, {p05} AS p05, {p95} AS p95, list(avg_pct) OVER {w30} AS l30,
                     list(volatility) OVER {w30} AS v30, count(volatility) OVER {w30} AS nv30,
                     list(breadth_pct) OVER {w63} AS b63, count(breadth_pct) OVER {w63} AS n63
              FROM {hist})"""


CTE["event_roll"] = (("event_hist",), roll_cte("event_hist"))
CTE["trade_roll"] = (("trade_hist",), roll_cte("trade_hist"))

HIST_COLS = ("date, n_gainers, n_losers, n_flat, avg_pct, volatility, skew_pct, kurt_pct, breadth_pct, regime, "
             "best_stock, best_pct, worst_stock, worst_pct, streak_sign")
ROLL_COLS = ("rolling_avg_7d, rolling_avg_30d, rolling_vol_7d, rolling_vol_30d, sma_avg_7d, sma_avg_30d, ema_avg_7d, "
             "ema_avg_30d, trend_persistence_7d, breadth_trend_persistence_7d, rolling_signal_7d, volatility_regime, "
             "vol_pct_rank, var_5, cvar_5, tail_ratio, regime_adaptive")


def with_(needs: str, body: str, **extra: str) -> str:
    """``WITH`` every CTE named in ``needs`` (and what they need), then ``extra`` CTEs, then ``body``."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        deps, sql = CTE[name]
        for d in deps:
            add(d)
        done[name] = sql

    for n in needs.split():
        add(n)
    done.update(extra)
    head = ",\n".join(f"{k} AS ({v})" for k, v in done.items())
    return f"WITH {head}\n{body}" if head else body
