"""Feature frame, mutual information and selection queries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tickloom.operators import features as X, indicators as I, preprocess as P
from tickloom.plans.registry import query
from tickloom.plans.sqlviews import CTE, r, skew_sql, w, with_
from tickloom.plans.symbols import RETURNS, lag, ohlcv
from tickloom.sources import sample as S

w7 = w(7, "symbol")


def trade_indicators(spark, sf):
    return I.indicator_suite(P.bar_returns(ohlcv(spark, sf)), complete=True)


def trade_features(spark, sf):
    return X.feature_set(trade_indicators(spark, sf))


def kept_features(spark, sf):
    """The feature table as the multi-pass rankings read it: computed once, kept by the executors, computed again where one is lost."""
    return trade_features(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)


def off(a: str, b: str) -> str:
    return r(f"{a} / nullif({b}, 0) - 1", 4)


CTE["ratios"] = (("suite",), f"""
    SELECT *, {off('close', 'sma_20')} AS price_vs_sma20, {off('close', 'sma_50')} AS price_vs_sma50,
           {off('sma_20', 'sma_50')} AS sma_crossover, {r('atr_14 / nullif(sma_20, 0)', 4)} AS atr_vs_sma20,
           {r('volume / nullif(volume_sma_20, 0)', 4)} AS volume_ratio FROM suite""")
CTE["feats"] = (("ratios",), f"""
    SELECT s.* EXCLUDE (returns_pct), x.returns_pct, x.log_returns, x.gap_pct, x.intraday_range_pct,
           {r('rsi_14 / 100 * volatility_21', 4)} AS rsi_x_vol, {r('momentum_10 * volume_ratio', 4)} AS momentum_x_volume,
           {r('macd_hist * bb_width', 4)} AS macd_x_bb, {r('price_vs_sma20 * ((rsi_14 - 50) / 50)', 4)} AS price_vs_sma20_x_rsi,
           {', '.join(f'''{lag('s.returns_pct', k, 's.symbol').replace('ORDER BY date', 'ORDER BY s.date')} AS returns_lag{k}''' for k in range(1, 6))},
           {', '.join(f'''{lag('rsi_14', k, 's.symbol').replace('ORDER BY date', 'ORDER BY s.date')} AS rsi_lag{k}''' for k in range(1, 4))},
           {', '.join(f'''{lag('macd_hist', k, 's.symbol').replace('ORDER BY date', 'ORDER BY s.date')} AS macd_hist_lag{k}''' for k in range(1, 4))},
           {r(f'avg(s.returns_pct) OVER w', 4)} AS return_rolling_mean_7d,
           {r(f'stddev_samp(s.returns_pct) OVER w', 4)} AS return_rolling_std_7d,
           {r(skew_sql('s.returns_pct', 'w'), 4)} AS return_rolling_skew_7d
    FROM ratios s JOIN ({RETURNS.format(src='tb')}) x USING (symbol, date)
    WINDOW w AS (PARTITION BY s.symbol ORDER BY s.date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
COLS = ", ".join(X.META + X.FEATURE_NAMES)
RATIO = "price_vs_sma20, price_vs_sma50, sma_crossover, atr_vs_sma20, volume_ratio"
INTER = "rsi_x_vol, momentum_x_volume, macd_x_bb, price_vs_sma20_x_rsi"


def cols(text: str) -> list[str]:
    return ["symbol", "date", *[c.strip() for c in text.split(",")]]


query("ratio_features", with_("ratios", f"SELECT symbol, date, {RATIO} FROM ratios"))(
    lambda s, d: X.ratio_features(I.indicator_suite(ohlcv(s, d), complete=True)).select(*cols(RATIO)))
query("interaction_features", with_("feats", f"SELECT symbol, date, {INTER} FROM feats"))(
    lambda s, d: X.interaction_features(X.ratio_features(I.indicator_suite(ohlcv(s, d), complete=True))).select(*cols(INTER)))
query("feature_set", with_("feats", f"SELECT {COLS} FROM feats"))(trade_features)

NORM = ["returns_pct", "rsi_14", "macd_hist", "volume_ratio"]
query("feature_set_normalised", with_("feats", "SELECT symbol, date, " + ", ".join(
    r(f"CASE WHEN stddev_samp({c}) OVER (PARTITION BY symbol) = 0 THEN {c} - avg({c}) OVER (PARTITION BY symbol) "
      f"ELSE ({c} - avg({c}) OVER (PARTITION BY symbol)) / stddev_samp({c}) OVER (PARTITION BY symbol) END", 6) + f" AS {c}"
    for c in NORM) + " FROM feats"))(
    lambda s, d: X.feature_set(trade_indicators(s, d), True).select("symbol", "date", *NORM))

def _norm_sql(f: str) -> str:
    o = "OVER (PARTITION BY symbol)"
    return (f"CASE WHEN stddev_samp({f}) {o} = 0 THEN {f} - avg({f}) {o} "
            f"ELSE {r(f'({f} - avg({f}) {o}) / nullif(stddev_samp({f}) {o}, 0)', 6)} END AS {f}")


query("feature_set_normalised_all", with_("feats", f"SELECT symbol, date, {', '.join(_norm_sql(f) for f in X.FEATURE_NAMES)} FROM feats"))(
    lambda s, d: X.feature_set(trade_indicators(s, d), True).select("symbol", "date", *X.FEATURE_NAMES))

WIDE_SYMBOLS, WIDE_NAMES = ["NATION_1", "NATION_2", "NATION_3"], ["returns_pct", "rsi_14"]
query("cross_asset_wide", with_("feats", "SELECT date, " + ", ".join(
    f'max({n}) FILTER (symbol = \'{s}\') AS "{s}_{n}"' for s in WIDE_SYMBOLS for n in WIDE_NAMES) +
    " FROM feats WHERE symbol IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY date"))(
    lambda s, d: X.cross_asset_wide(trade_features(s, d), WIDE_SYMBOLS, WIDE_NAMES))

FEATS = X.FEATURE_NAMES
complete = " AND ".join(f"{c} IS NOT NULL" for c in FEATS)
CTE["whole"] = (("feats",), f"SELECT {', '.join(FEATS)} FROM feats WHERE {complete}")
names = [f for f in FEATS if f != "returns_pct"]
edges = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"
CTE["mi_long"] = (("whole",), "SELECT y, feature, x FROM (SELECT returns_pct AS y, "
                  + ", ".join(names) + f" FROM whole) UNPIVOT (x FOR feature IN ({', '.join(names)}))")
query("mutual_information", with_("mi_long", f"""
    , xe AS (SELECT feature, list_distinct(quantile_cont(x, {edges})) AS e FROM mi_long GROUP BY feature),
    ye AS (SELECT list_distinct(quantile_cont(returns_pct, {edges})) AS e FROM whole),
    b AS (SELECT feature, greatest(len(list_filter(xe.e, lambda v: v < x)), 1) AS xb,
                 greatest(len(list_filter(ye.e, lambda v: v < y)), 1) AS yb FROM mi_long JOIN xe USING (feature), ye),
    j AS (SELECT feature, xb, yb, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
    p AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p,
                 (sum(n) OVER (PARTITION BY feature, xb) / sum(n) OVER (PARTITION BY feature))
                 * (sum(n) OVER (PARTITION BY feature, yb) / sum(n) OVER (PARTITION BY feature)) AS q FROM j)
    SELECT feature, greatest(0.0, {r('sum(p * ln(p / q))', 6)}) AS mutual_information FROM p GROUP BY feature""")
      .replace(")\n\n    , xe", "),\n xe"))(lambda s, d: X.mutual_information(kept_features(s, d), FEATS))


def rel(x: str) -> str:
    """Round to 8 significant digits: variances span many orders of magnitude."""
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE {r(f'{x} / pow(10, floor(log10(abs({x}))))', 6)} END"


query("variance_filter", with_("whole", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {i + 1}::INTEGER AS position, count(*) = 0 OR coalesce(var_samp({f}) >= 1e-5, false) AS kept, "
    f"{r(f'log10(nullif(var_samp({f}), 0))', 4)} AS log_variance FROM whole" for i, f in enumerate(FEATS))))(
    lambda s, d: X.variance_filter(trade_features(s, d), FEATS).select(
        "feature", "position", "kept", X.rnd(F.log10(F.nullif("variance", F.lit(0.0))), 4).alias("log_variance")))


def pair_sql(src: str) -> str:
    """(i, j, a): |correlation| of every pair of features, from one pass over ``src``."""
    pairs = [(i, j) for j in range(len(FEATS)) for i in range(j)]
    row = ", ".join(f"corr({FEATS[i]}, {FEATS[j]}) AS c_{i}_{j}" for i, j in pairs)
    return (f"SELECT split_part(pair, '_', 2)::INTEGER AS i, split_part(pair, '_', 3)::INTEGER AS j, abs(c) AS a "
            f"FROM (SELECT {row} FROM {src}) UNPIVOT INCLUDE NULLS (c FOR pair IN ({', '.join(f'c_{i}_{j}' for i, j in pairs)}))")


NAMED = "(VALUES " + ", ".join(f"('{f}', {i})" for i, f in enumerate(FEATS)) + ") AS f(feature, k)"
query("correlation_filter", with_("whole", f"""
    , c AS ({pair_sql('whole')})
    SELECT feature, (k + 1)::INTEGER AS position, max({r('a', 6)}) AS max_abs_r, coalesce(max({r('a', 6)}) < 0.92, true) AS kept
    FROM {NAMED} LEFT JOIN c ON j = k GROUP BY feature, k""").replace(")\n\n    , c", "),\n c"))(
    lambda s, d: X.correlation_filter(trade_features(s, d), FEATS))
# Survivors of the variance pass decide which rows the correlation pass sees.
LIVE = {f: f"(n = 0 OR coalesce(v_{f} >= 1e-5, false))" for f in FEATS}
query("select_features", with_("whole", f"""
    , v AS (SELECT count(*) AS n, {', '.join(f'var_samp({f}) AS v_{f}' for f in FEATS)} FROM whole),
    seen AS (SELECT feats.* FROM feats, v WHERE {' AND '.join(f'({f} IS NOT NULL OR NOT {LIVE[f]})' for f in FEATS)}),
    live AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {i} AS k FROM v WHERE {LIVE[f]}" for i, f in enumerate(FEATS))}),
    c AS ({pair_sql('seen')})
    SELECT feature, (k + 1)::INTEGER AS position FROM live WHERE k NOT IN (
        SELECT j FROM c WHERE a >= 0.92 AND i IN (SELECT k FROM live))""").replace(")\n\n    , v", "),\n v"))(
    lambda s, d: X.select_features(trade_features(s, d), FEATS))
