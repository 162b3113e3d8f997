"""Descriptive statistics, rank tests, distribution tables and top-k queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tickloom import config as cfg
from tickloom.functions import ladders
from tickloom.functions.numeric import div, rnd
from tickloom.operators import stats as T
from tickloom.plans.market import event_hist
from tickloom.plans.registry import query
from tickloom.plans.sqlviews import CTE, kurt_sql, r, skew_sql, with_
from tickloom.sources import sample as S


def ep(spark, sf):
    return S.event_prices(spark, sf)


STATUS = "CASE WHEN change > 0 THEN 'Gainer' WHEN change < 0 THEN 'Loser' ELSE 'Flat' END"
TIER = " ".join(["CASE"] + [f"WHEN price > {a} AND price <= {b} THEN '{t}'" for a, b, t in
                            zip(cfg.TIER_EDGES, cfg.TIER_EDGES[1:], cfg.TIER_LABELS)] + ["END"])

query("describe", with_("event_prices", " UNION ALL ".join(f"""
    SELECT date, '{c}' AS "column", count({c}) AS count, {r(f'avg({c})', 2)} AS mean, {r(f'stddev_samp({c})', 2)} AS std,
           {r(f'min({c})', 2)} AS min, {r(f'max({c})', 2)} AS max, {r(f'quantile_cont({c}, 0.25)', 2)} AS p25,
           {r(f'quantile_cont({c}, 0.5)', 2)} AS p50, {r(f'quantile_cont({c}, 0.75)', 2)} AS p75
    FROM event_prices GROUP BY date""" for c in ("price", "change", "pct_change"))))(
    lambda s, d: T.describe(ep(s, d), ["price", "change", "pct_change"], ["date"]))

query("session_breadth", with_("event_prices", f"""
    SELECT date, count(*) AS n_total, count_if(change > 0)::BIGINT AS n_gain, count_if(change < 0)::BIGINT AS n_loss,
           count_if(change = 0)::BIGINT AS n_flat, {r('count_if(change > 0) / count(*) * 100', 4)} AS gain_pct,
           {r('count_if(change < 0) / count(*) * 100', 4)} AS loss_pct, {r('count_if(change = 0) / count(*) * 100', 4)} AS flat_pct,
           {r('avg(pct_change)', 4)} AS avg_chg, first(symbol ORDER BY pct_change DESC, symbol) AS top_sym,
           {r('max(pct_change)', 4)} AS top_pct, first(symbol ORDER BY pct_change, symbol) AS bot_sym,
           {r('min(pct_change)', 4)} AS bot_pct, max(price) AS price_max, min(price) AS price_min,
           {r('median(pct_change) FILTER (change > 0)', 4)} AS gainer_pct_median,
           {r('median(pct_change) FILTER (change < 0)', 4)} AS loser_pct_median,
           {r('median(price) FILTER (change > 0)', 4)} AS gainer_price_median,
           {r('median(price) FILTER (change < 0)', 4)} AS loser_price_median
    FROM event_prices GROUP BY date"""))(lambda s, d: T.session_breadth(ep(s, d)))

query("group_means", with_("event_prices", f"""
    SELECT date, {STATUS} AS status, {r('avg(price)', 2)} AS avg_price, {r('avg(change)', 2)} AS avg_change,
           {r('avg(pct_change)', 2)} AS avg_pct_change FROM event_prices GROUP BY 1, 2"""))(
    lambda s, d: T.group_means(ep(s, d)))

CTE["fences"] = (("event_prices",), """
    SELECT date, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM event_prices GROUP BY date""")
query("iqr_outliers", with_("fences", f"""
    SELECT date, symbol, price, {r('q1', 6)} AS q1, {r('q3', 6)} AS q3, {r('q3 + 1.5 * (q3 - q1)', 6)} AS upper_fence
    FROM event_prices JOIN fences USING (date) WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)"""))(
    lambda s, d: T.iqr_outliers(ep(s, d)).select(
        "date", "symbol", "price", *[rnd(F.col(c), 6).alias(c) for c in ("q1", "q3", "upper_fence")]))

query("null_dup_audit", with_("event_prices", """
    SELECT date, count_if(symbol IS NULL)::BIGINT AS null_symbol, count_if(company_name IS NULL)::BIGINT AS null_company_name,
           count_if(price IS NULL)::BIGINT AS null_price, count_if(change IS NULL)::BIGINT AS null_change,
           count_if(pct_change IS NULL)::BIGINT AS null_pct_change, count(symbol) - count(DISTINCT symbol) AS duplicate_symbols,
           count_if(price <= 0)::BIGINT AS invalid_prices FROM event_prices GROUP BY date"""))(
    lambda s, d: T.null_dup_audit(ep(s, d)))


def ranks(c: str) -> str:
    return f"rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0::DOUBLE AS r_{c}"


CTE["ranked"] = (("event_prices",), f"""SELECT date, {ranks('price')}, {ranks('change')}, {ranks('pct_change')} FROM event_prices
    WHERE price IS NOT NULL AND change IS NOT NULL AND pct_change IS NOT NULL""")
# Student's t by gamma functions: the sums are over whole degrees of freedom.
STUDENT = """CASE WHEN n < 3 OR rho IS NULL THEN NULL WHEN abs(rho) >= 1 THEN 0.0 WHEN n % 2 = 0 THEN 1 - s * coalesce(list_sum(list_transform(
        range(0, (n - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - ln(pi()) / 2 + k * ln(c2)))), 0)
    ELSE 1 - 2 / pi() * (asin(s) + s * sqrt(c2) * sqrt(pi()) / 2 * coalesce(list_sum(list_transform(
        range(0, (n - 3) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + k * ln(c2)))), 0)) END"""
SPEARMAN = """
    SELECT n, date, x, y, rho, t_stat, p_value, coalesce(p_value < 0.05, false) AS significant, CASE WHEN rho IS NULL THEN 'undefined' WHEN abs(rho) < 0.1 THEN 'negligible'
           WHEN abs(rho) < 0.3 THEN 'weak' WHEN abs(rho) < 0.5 THEN 'moderate' ELSE 'strong' END AS strength,
           CASE WHEN rho < 0 THEN 'negative' WHEN rho >= 0 THEN 'positive' ELSE 'undefined' END AS direction
    FROM (SELECT *, {p} AS p_value FROM (SELECT *, {t} AS t_stat, (n - 2) / (n - 2 + tt * tt) AS c2, abs(tt) / sqrt(n - 2 + tt * tt) AS s
          FROM (SELECT *, CASE WHEN abs(rho) < 1 THEN rho * sqrt(greatest(n - 2, 0)) / nullif(sqrt(1 - rho * rho), 0) END AS tt FROM ({pairs}))))"""
PAIRS = " UNION ALL ".join(
    f"SELECT date, count(*) AS n, '{a}' AS x, '{b}' AS y, {r(f'corr(r_{a}, r_{b})', 6)} AS rho FROM ranked GROUP BY date"
    for a, b in (("price", "change"), ("price", "pct_change"), ("change", "pct_change")))
SPEARMAN = SPEARMAN.format(pairs=PAIRS, t=r("tt", 6), p=r(STUDENT, 4))
query("spearman_matrix", with_("ranked", SPEARMAN))(
    lambda s, d: T.spearman(ep(s, d), ["price", "change", "pct_change"]))

CTE["mw"] = (("event_prices",), f"""
    SELECT date, count_if(change > 0)::BIGINT AS n_gain, count_if(change < 0)::BIGINT AS n_loss,
           sum(rk) FILTER (change > 0) - count_if(change > 0) * (count_if(change > 0) + 1) / 2.0::DOUBLE AS u,
           sum(pow(c, 2) - 1) AS ties
    FROM (SELECT date, change, price, count(*) OVER (PARTITION BY date, price) AS c, rank() OVER (PARTITION BY date ORDER BY price)
                 + (count(*) OVER (PARTITION BY date, price) - 1) / 2.0::DOUBLE AS rk FROM event_prices WHERE change <> 0)
    GROUP BY date HAVING count_if(change > 0) > 0 AND count_if(change < 0) > 0""")
SIGMA = ("sqrt(n_gain * n_loss / 12.0::DOUBLE * (n_gain + n_loss + 1 - ties / nullif((n_gain + n_loss) "
         "* (n_gain + n_loss - 1.0::DOUBLE), 0)))")
ZT = "1 / (1 + 0.3275911::DOUBLE * z / sqrt(2))"
ERFC = (f"least(1.0::DOUBLE, (({ZT}) * (0.254829592::DOUBLE + ({ZT}) * (-0.284496736::DOUBLE + ({ZT}) * (1.421413741::DOUBLE "
        f"+ ({ZT}) * (-1.453152027::DOUBLE + ({ZT}) * 1.061405429::DOUBLE))))) * exp(-z * z / 2))")
MW = f"""SELECT *, p_value IS NOT NULL AND p_value < 0.05 AS reject FROM (
    SELECT date, n_gain, n_loss, {r('u', 1)} AS u_stat, {r('z', 6)} AS z, {r(ERFC, 4)} AS p_value FROM (
    SELECT *, greatest(abs(u - n_gain * n_loss / 2.0::DOUBLE) - 0.5::DOUBLE, 0) / nullif({SIGMA}, 0) AS z FROM mw))"""
query("mann_whitney", with_("mw", MW))(lambda s, d: T.mann_whitney(ep(s, d)))

query("jarque_bera", with_("event_prices", f"""
    SELECT date, n, {r('jb', 4)} AS jb, {r('exp(-jb / 2)', 6)} AS p_value, {r('exp(-jb / 2)', 6)} < 0.05 AS non_normal FROM (
    SELECT date, n, n / 6.0::DOUBLE * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / pow(m2, 2) - 3, 2) / 4) AS jb FROM (
    SELECT date, count(*) AS n, avg(pow(price - m, 2)) AS m2, avg(pow(price - m, 3)) AS m3, avg(pow(price - m, 4)) AS m4
    FROM (SELECT date, price, avg(price) OVER (PARTITION BY date) AS m FROM event_prices) GROUP BY date) WHERE n >= 3)"""))(
    lambda s, d: T.jarque_bera(ep(s, d), "price"))

TIER_DIM = ", ".join(f"({i}::INTEGER, '{t}')" for i, t in enumerate(cfg.TIER_LABELS))
query("tier_counts", with_("event_prices", f"""
    SELECT d.date, t.tier_order, t.price_tier, count(p.symbol) AS n FROM (SELECT DISTINCT date FROM event_prices) d
    JOIN (VALUES {TIER_DIM}) t(tier_order, price_tier) ON true
    LEFT JOIN (SELECT *, {TIER} AS tier FROM event_prices) p ON p.date = d.date AND p.tier = t.price_tier
    GROUP BY ALL"""))(lambda s, d: T.tier_counts(ep(s, d)))


def box(group: str, name: str, value: str) -> str:
    ok = "v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)"
    return with_("event_prices", f"""
        SELECT date, {name}, count(v) AS n, count_if(NOT ({ok}))::BIGINT AS n_outliers, {r(f'min(v) FILTER ({ok})', 4)} AS whisker_low,
               {r('q1', 4)} AS q1, {r('q2', 4)} AS median, {r('q3', 4)} AS q3, {r(f'max(v) FILTER ({ok})', 4)} AS whisker_high
        FROM (SELECT date, {group} AS {name}, {value} AS v, quantile_cont({value}, 0.25) OVER g AS q1,
                     quantile_cont({value}, 0.5) OVER g AS q2, quantile_cont({value}, 0.75) OVER g AS q3
              FROM event_prices WHERE {group} IS NOT NULL WINDOW g AS (PARTITION BY date, {group}))
        GROUP BY ALL""").replace("GROUP BY ALL", f"GROUP BY date, {name}, q1, q2, q3")


query("tier_box", box(TIER, "price_tier", "pct_change"))(
    lambda s, d: T.box_stats(ep(s, d), ladders.price_tier(F.col("price")), "price_tier", "pct_change"))
query("status_box", box(STATUS, "status", "price"))(
    lambda s, d: T.box_stats(ep(s, d), ladders.status(F.col("change")), "status", "price"))
query("price_histogram", with_("event_prices", """
    SELECT date, least(coalesce(floor((price - lo) / nullif(hi - lo, 0) * 25), 0), 24)::INTEGER AS bin, count(*) AS n
    FROM event_prices JOIN (SELECT date, min(price) AS lo, max(price) AS hi FROM event_prices GROUP BY date) USING (date)
    GROUP BY 1, 2"""))(lambda s, d: T.histogram(ep(s, d), "price", 25))
query("status_counts", with_("event_prices", f"SELECT {STATUS} AS status, count(*) AS n FROM event_prices GROUP BY 1"))(
    lambda s, d: ep(s, d).groupBy(ladders.status(F.col("change")).alias("status")).agg(F.count(F.lit(1)).alias("n")))

query("session_scalars", with_("event_prices", f"""
    SELECT date, g - l AS net_breadth, {r('sp', 4)} AS volatility_span, high_move_count, low_price_count, big_move_symbol,
           CASE WHEN g / n * 100 >= 70 THEN 'broad advance' WHEN g / n * 100 >= 55 THEN 'moderate advance'
                WHEN g / n * 100 >= 45 THEN 'mixed session' WHEN g / n * 100 >= 30 THEN 'moderate decline'
                ELSE 'broad decline' END AS breadth_label,
           CASE WHEN g > l THEN 'Bullish' WHEN l > g THEN 'Bearish' ELSE 'Mixed' END AS session_label,
           CASE WHEN g > l THEN 'risk-on' WHEN l > g THEN 'risk-off' ELSE 'balanced' END AS momentum_word,
           CASE WHEN sk > 1 THEN 'right-skewed' WHEN sk < -1 THEN 'left-skewed' ELSE 'roughly balanced' END AS skew_label
    FROM (SELECT date, count_if(change > 0)::BIGINT AS g, count_if(change < 0)::BIGINT AS l, count(*) AS n,
                 max(pct_change) - min(pct_change) AS sp, count_if(abs(pct_change) >= 5)::BIGINT AS high_move_count,
                 count_if(price < 25)::BIGINT AS low_price_count, first(symbol ORDER BY abs(change) DESC, symbol) AS big_move_symbol,
                 {r(skew_sql('price'), 4)} AS sk FROM event_prices GROUP BY date)"""))(
    lambda s, d: T.session_scalars(ep(s, d)))

query("day_report", with_("fences ranked mw", f"""
    SELECT date, n_total, price_mean, price_median, price_std, price_skew, price_kurt, {r('f.q1', 4)} AS q1, {r('f.q3', 4)} AS q3,
           {r('f.q3 - f.q1', 4)} AS iqr, {r('f.q3 + 1.5 * (f.q3 - f.q1)', 4)} AS upper_fence,
           coalesce(o.n_outliers, 0) AS n_outliers, sp.rho AS sp_corr, sp.p_value AS sp_p, sp.strength AS sp_strength, m.u_stat,
           m.p_value AS mw_p, m.reject AS mw_reject
    FROM (SELECT date, count(*) AS n_total, {r('avg(price)', 4)} AS price_mean, {r('median(price)', 4)} AS price_median,
                 {r('stddev_samp(price)', 4)} AS price_std, {r(skew_sql('price'), 4)} AS price_skew,
                 {r(kurt_sql('price'), 4)} AS price_kurt FROM event_prices GROUP BY date)
    JOIN fences f USING (date)
    LEFT JOIN (SELECT date, count(*) AS n_outliers FROM event_prices JOIN fences USING (date)
               WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1) GROUP BY date) o USING (date)
    LEFT JOIN (SELECT * FROM ({SPEARMAN}) WHERE x = 'price' AND y = 'pct_change') sp USING (date)
    LEFT JOIN ({MW}) m USING (date)"""))(lambda s, d: T.day_report(ep(s, d)))

LADDER_STD = "volatility / nullif(b, 0)"
query("label_ladders", with_("event_hist", f"""
    SELECT date, CASE WHEN breadth_pct >= 70 THEN 'broad advance' WHEN breadth_pct >= 55 THEN 'moderate advance'
                WHEN breadth_pct >= 45 THEN 'mixed session' WHEN breadth_pct >= 30 THEN 'moderate decline'
                ELSE 'broad decline' END AS breadth_label,
           CASE WHEN b IS NULL OR b = 0 THEN 'indeterminate volatility' WHEN {LADDER_STD} >= 1.5 THEN 'elevated volatility'
                WHEN {LADDER_STD} >= 1.1 THEN 'slightly elevated volatility' WHEN {LADDER_STD} >= 0.9 THEN 'normal volatility'
                ELSE 'suppressed volatility' END AS vol_label,
           CASE WHEN skew_pct > 1 THEN 'right-skewed' WHEN skew_pct < -1 THEN 'left-skewed' ELSE 'roughly balanced' END AS skew_label,
           CASE WHEN n_gainers > n_losers THEN 'risk-on' WHEN n_losers > n_gainers THEN 'risk-off' ELSE 'balanced' END AS momentum_word
    FROM (SELECT *, avg(volatility) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM event_hist)"""))(
    lambda s, d: event_hist(s, d).withColumn(
        "b", F.avg("volatility").over(Window.partitionBy("universe").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)))
    .select("date", ladders.breadth_label(F.col("breadth_pct")).alias("breadth_label"),
            ladders.vol_label(F.col("volatility"), F.col("b")).alias("vol_label"),
            ladders.skew_word(F.col("skew_pct")).alias("skew_label"),
            ladders.momentum_word(F.col("n_gainers"), F.col("n_losers")).alias("momentum_word")))


def ranked(df, order, n, by=("date",)):
    """Top-k per group: the rank filter turns into a group limit inside each map task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def top_movers(p):
    pct = F.col("pct_change")
    known = p.where(pct.isNotNull())
    up = ranked(known, [pct.desc(), F.col("symbol")], 10).withColumn("list", F.lit("gainers"))
    down = ranked(known, [pct.asc(), F.col("symbol")], 10).withColumn("list", F.lit("losers"))
    swing = ranked(p, [F.abs("change").desc(), F.col("symbol")], 15).withColumn("list", F.lit("swings"))
    return up.unionByName(down).unionByName(swing).select("list", "date", "rank", "symbol", "pct_change", "change")


query("top_movers", with_("event_prices", " UNION ALL ".join(
    f"SELECT '{name}' AS list, date, rank, symbol, pct_change, change FROM (SELECT *, (row_number() OVER (PARTITION BY date "
    f"ORDER BY {o}, symbol))::INTEGER AS rank FROM event_prices WHERE {k} IS NOT NULL) WHERE rank <= {n}"
    for name, o, k, n in (("gainers", "pct_change DESC", "pct_change", 10), ("losers", "pct_change", "pct_change", 10),
                          ("swings", "abs(change) DESC", "change", 15)))))(
    lambda s, d: top_movers(ep(s, d)))
query("screener_latest", with_("event_prices", """
    SELECT symbol, price, change, pct_change FROM event_prices WHERE date = (SELECT max(date) FROM event_prices)"""))(
    lambda s, d: (lambda p: p.where(F.col("date") == p.select(F.max("date")).scalar())
                  .select("symbol", "price", "change", "pct_change").orderBy(F.col("pct_change").desc(), "symbol"))(ep(s, d)))
query("top_volume_symbols", with_("event_bars", """
    SELECT symbol, volume FROM event_bars WHERE date = (SELECT max(date) FROM event_bars)
    ORDER BY volume DESC, symbol LIMIT 15"""))(
    lambda s, d: (lambda b: T.top_volume(b, b.select(F.max("date")).scalar()))(S.event_bars(s, d)))
query("top_volume_no_trades", with_("event_bars", """
    SELECT DISTINCT symbol, NULL::DOUBLE AS volume FROM event_bars ORDER BY symbol LIMIT 15"""))(
    lambda s, d: T.top_volume(S.event_bars(s, d), F.lit("1990-01-01").cast("date")))
