"""Signal, anomaly and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import anomalies as N, forecast as FC, sentiment as SE, signals as G
from tickloom.plans.market import event_hist, trade_hist
from tickloom.plans.registry import query
from tickloom.plans.sqlviews import CTE, ewm_sql, r, w, wall, with_
from tickloom.sources import sample as S


def sentiment(spark, sf):
    return SE.headline_sentiment(S.headlines(spark, sf))


def trade_enriched(spark, sf):
    return G.enrich(S.trade_prices(spark, sf), sentiment(spark, sf))


def event_enriched(spark, sf):
    return G.enrich(S.event_prices(spark, sf))


CTE["with_sent"] = (("trade_prices", "sentiment"), """
    SELECT p.*, CASE WHEN p.date IN (SELECT date FROM sentiment) THEN e.sentiment_score ELSE a.sentiment_score END AS sentiment_score,
           coalesce(CASE WHEN p.date IN (SELECT date FROM sentiment) THEN e.sentiment_label ELSE a.sentiment_label END, 'No Data')
               AS sentiment_label
    FROM trade_prices p LEFT JOIN sentiment e ON e.symbol = p.symbol AND e.date = p.date
    ASOF LEFT JOIN sentiment a ON a.symbol = p.symbol AND p.date >= a.date""")
CTE["event_sent"] = (("event_prices",), "SELECT *, NULL::DOUBLE AS sentiment_score FROM event_prices")


def enriched_cte(src: str, hist: str) -> str:
    w7, pw = w(7, "symbol"), wall("symbol")
    return f"""
        SELECT p.*, m.mkt_avg, m.mkt_std, m.baseline_vol,
               {r(f'(pct_change - avg(pct_change) OVER w7) / nullif(stddev_samp(pct_change) OVER w7, 0)', 4)} AS z7,
               row_number() OVER (PARTITION BY symbol ORDER BY p.date) AS rows_so_far, count(pct_change) OVER pw AS hist_n,
               avg(pct_change) OVER pw AS hist_mean, stddev_samp(pct_change) OVER pw AS hist_std, max(price) OVER pw AS hist_peak
        FROM {src} p JOIN (
            SELECT date, mkt_avg, mkt_std, coalesce(nullif(avg({r('mkt_std', 6)}) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING
                   AND 1 PRECEDING), 0), 1.0) AS baseline_vol
            FROM (SELECT date, avg(pct_change) AS mkt_avg, stddev_samp(pct_change) AS mkt_std FROM {src} GROUP BY date)) m USING (date)
        WINDOW w7 AS {w7.replace('ORDER BY date', 'ORDER BY p.date')}, pw AS {pw.replace('ORDER BY date', 'ORDER BY p.date')}"""


CTE["te"] = (("with_sent",), enriched_cte("with_sent", ""))
CTE["ee"] = (("event_sent",), enriched_cte("event_sent", ""))


def sg(x: str, n: int) -> str:
    return f"printf('%+.{n}f', {r(x, n)})"


def fx(x: str, n: int) -> str:
    return f"printf('%.{n}f', {r(x, n)})"


BULL = "CASE WHEN pct_change >= 0 THEN 'Bullish' ELSE 'Bearish' END"
STD = "CASE WHEN mkt_std > 0 THEN mkt_std ELSE baseline_vol END"
THR = f"greatest({STD}, baseline_vol) * 1.5"
Z = r("(pct_change - hist_mean) / nullif(hist_std, 0)", 6)
SPIKE = r(f"abs(pct_change) / greatest({STD}, 0.001)", 4)


def signal_sql(kind: str, src: str) -> str:
    return {
        "momentum_breakout": f"""
            SELECT symbol, date, 'momentum_breakout' AS signal_type, {BULL} AS direction, z7 AS strength, abs(z7) AS score,
                   symbol || ' moved ' || {sg('pct_change', 2)} || '% today — z-score ' || {sg('z7', 2)} || ' vs 7-day history' AS reason
            FROM {src} WHERE rows_so_far >= 3 AND abs(z7) >= 1.5""",
        "volatility_spike": f"""
            SELECT symbol, date, 'volatility_spike' AS signal_type, {BULL} AS direction, {r('abs(pct_change)', 4)} AS strength,
                   {SPIKE} AS score, symbol || ' moved ' || {sg('pct_change', 2)} || '% vs market threshold ' || {fx(THR, 2)}
                   || '% (ratio: ' || {fx(SPIKE, 2)} || 'x)' AS reason
            FROM {src} WHERE baseline_vol > 0 AND abs(pct_change) >= {THR}""",
        "sentiment_divergence": f"""
            SELECT symbol, date, 'sentiment_divergence' AS signal_type, CASE WHEN pct_change > 0 THEN 'Bearish' ELSE 'Bullish' END
                   AS direction, {r('abs(sentiment_score)', 4)} AS strength, {r('abs(sentiment_score) * abs(pct_change) / 100', 4)} AS score,
                   symbol || CASE WHEN pct_change > 0 THEN ': price up ' ELSE ': price down ' END || {sg('pct_change', 2)}
                   || '% but sentiment ' || {sg('sentiment_score', 4)} || CASE WHEN pct_change > 0
                   THEN ' — price may be running ahead of news' ELSE ' — possible oversold opportunity' END AS reason
            FROM {src} WHERE (pct_change > 0.5 AND sentiment_score < -0.1) OR (pct_change < -0.5 AND sentiment_score > 0.1)""",
        "unusual_mover": f"""
            SELECT symbol, date, 'unusual_mover' AS signal_type, CASE WHEN {Z} > 0 THEN 'Bullish' ELSE 'Bearish' END AS direction,
                   {r(f'abs({Z})', 4)} AS strength, {r(f'abs({Z})', 4)} AS score, symbol || ' moved ' || {sg('pct_change', 2)}
                   || '% — z-score ' || {sg(Z, 2)} || ' vs full history (mean ' || {sg('hist_mean', 2)} || '%, std '
                   || {fx('hist_std', 2)} || '%)' AS reason
            FROM {src} WHERE hist_n >= 5 AND abs({Z}) >= 2.0""",
    }[kind]


for kind in G.DETECTORS:
    if kind == "sentiment_divergence":
        query(kind, with_("te", signal_sql(kind, "te")))(lambda s, d, k=kind: G.detect(trade_enriched(s, d), k))
    else:
        query(kind, with_("ee", signal_sql(kind, "ee")))(lambda s, d, k=kind: G.detect(event_enriched(s, d), k))
ALL_SIGNALS = " UNION ALL ".join(signal_sql(k, "te") for k in G.DETECTORS)
query("all_signals", with_("te", ALL_SIGNALS))(lambda s, d: G.all_signals(trade_enriched(s, d)))
query("signal_log", with_("te", f"""
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(score) DESC NULLS LAST, symbol, signal_type, reason)::INTEGER AS rank
    FROM ({ALL_SIGNALS})"""))(lambda s, d: G.log_order(G.all_signals(trade_enriched(s, d)), "score", "signal_type"))

SCORE = r("v * 30 + z * 40 + dd * 0.3", 2)
RISK = f"""
    SELECT symbol, date, CASE WHEN {SCORE} > 100 THEN 100.0 ELSE {SCORE} END AS risk_score, CASE WHEN {SCORE} >= 70 THEN 'High Risk'
           WHEN {SCORE} >= 40 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_label, {r('v', 4)} AS vol_ratio,
           {r('z', 4)} AS hist_z, {r('dd', 4)} AS drawdown
    FROM (SELECT symbol, date, abs(pct_change) / greatest(baseline_vol, 0.001) AS v,
                 CASE WHEN hist_n >= 3 THEN abs((pct_change - hist_mean) / greatest(hist_std, 0.001)) ELSE 0.0 END AS z,
                 CASE WHEN hist_peak IS NOT NULL THEN greatest(0.0, (hist_peak - price) / greatest(hist_peak, 0.001) * 100)
                      ELSE 0.0 END AS dd FROM {{src}})"""
query("risk_scores", with_("ee", RISK.format(src="ee")))(lambda s, d: G.risk_scores(event_enriched(s, d)).drop("universe"))
OSCORE = r("m * 0.4 + z * 0.4 + s * 20.0 * 0.2", 4)
OPP = f"""
    SELECT symbol, date, {OSCORE} AS opportunity_score, CASE WHEN {OSCORE} > 1.0 THEN 'Strong Buy Signal'
           WHEN {OSCORE} > 0.3 THEN 'Moderate Opportunity' WHEN {OSCORE} < -1.0 THEN 'Strong Sell Signal'
           WHEN {OSCORE} < -0.3 THEN 'Moderate Risk' ELSE 'Neutral' END AS opportunity_label, {r('m', 4)} AS rel_momentum,
           {r('z', 4)} AS signal_z, {r('s', 4)} AS sentiment
    FROM (SELECT symbol, date, pct_change - mkt_avg AS m, CASE WHEN hist_n >= 3 THEN (pct_change - hist_mean)
                 / greatest(hist_std, 0.001) ELSE 0.0 END AS z, coalesce(sentiment_score, 0.0) AS s FROM te)"""
query("opportunity", with_("te", OPP))(lambda s, d: G.opportunities(trade_enriched(s, d)).drop("universe"))
query("opportunity_top", with_("te", f"""SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY date
    ORDER BY abs(opportunity_score) DESC, symbol))::INTEGER AS rank FROM ({OPP})) WHERE rank <= 10"""))(
    lambda s, d: G.top_opportunities(G.opportunities(trade_enriched(s, d))).drop("universe"))
query("signal_summary", with_("te", f"""SELECT date, count(*) AS n_active, count_if(direction = 'Bullish')::BIGINT AS n_bullish,
    count_if(direction = 'Bearish')::BIGINT AS n_bearish FROM ({ALL_SIGNALS}) GROUP BY date"""))(
    lambda s, d: G.signal_summary(G.all_signals(trade_enriched(s, d))))

# --- anomalies -------------------------------------------------------------------------------------------------------
SEV = "CASE WHEN abs({z}) >= 3.5 THEN 'Critical' WHEN abs({z}) >= 3.0 THEN 'High' ELSE 'Moderate' END"


def gap_sql(src: str) -> str:
    return f"""
        SELECT date, symbol, 'price_gap' AS anomaly_type, {SEV.format(z=Z)} AS severity, {r(Z, 4)} AS z_score,
               {r('pct_change', 4)} AS value, symbol || ' moved ' || {sg('pct_change', 2)} || '% — z-score ' || {sg(Z, 2)} || ' (mu='
               || {sg('hist_mean', 2)} || '%, sigma=' || {fx('hist_std', 2)} || '%, n=' || hist_n || ' days)' AS reason
        FROM {src} WHERE hist_n >= 20 AND abs({Z}) >= 2.5"""


def market_sql(kind: str, metric: str, reason: str, hist: str) -> str:
    o = "(ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
        SELECT date, NULL::VARCHAR AS symbol, '{kind}' AS anomaly_type, {SEV.format(z='z')} AS severity, {r('z', 4)} AS z_score,
               {r('v', 4)} AS value, {reason} AS reason
        FROM (SELECT *, {r('(v - mu) / nullif(sd, 0)', 6)} AS z FROM (
              SELECT date, {metric} AS v, row_number() OVER (ORDER BY date) AS i, avg({metric}) OVER {o} AS mu,
                     stddev_samp({metric}) OVER {o} AS sd FROM {hist} WHERE {metric} IS NOT NULL)) WHERE i >= 20 AND abs(z) >= 2.0"""


VOLREG = market_sql("vol_regime", "volatility", f"""'Market volatility ' || {fx('v', 4)} || '% is ' || {fx('abs(z)', 2)}
    || ' std devs ' || CASE WHEN z > 0 THEN 'above' ELSE 'below' END || ' its historical mean (mu=' || {fx('mu', 4)}
    || '%, sigma=' || {fx('sd', 4)} || '%)'""", "trade_hist")
BREADTH = market_sql("breadth_extreme", "breadth_pct", f"""'Market breadth ' || {fx('v', 1)} || '% is historically '
    || CASE WHEN z > 0 THEN 'overbought' ELSE 'oversold' END || ' (z=' || {sg('z', 2)} || ', mu=' || {fx('mu', 1)}
    || '%, sigma=' || {fx('sd', 1)} || '%)'""", "trade_hist")


def cluster_sql(prices: str) -> str:
    side = """SELECT date, '{w}side' AS label, count(*) AS n, count_if(pct_change {op})::BIGINT AS k,
              avg(pct_change) FILTER (pct_change {op}) AS a FROM {p} GROUP BY date"""
    return f"""
        SELECT date, NULL::VARCHAR AS symbol, 'cluster_spike' AS anomaly_type, CASE WHEN k / n >= 0.60 THEN 'Critical'
               WHEN k / n >= 0.45 THEN 'High' ELSE 'Moderate' END AS severity, {r('k / n', 4)} AS z_score, {r('a', 4)} AS value,
               k || ' of ' || n || ' stocks (' || {fx('k / n * 100', 0)} || '%) showed strong ' || label || ' moves (avg '
               || {sg('a', 2)} || '%) — coordinated macro-driven session' AS reason
        FROM ({side.format(w='up', op='>= 2.0', p=prices)} UNION ALL {side.format(w='down', op='<= -2.0', p=prices)})
        WHERE k / n >= 0.30"""


DIVERGE = f"""
    SELECT date, NULL::VARCHAR AS symbol, 'sent_vol_divergence' AS anomaly_type, CASE WHEN rr < -0.75 THEN 'High' ELSE 'Moderate' END
           AS severity, rr AS z_score, rr AS value, 'Sentiment-volatility rolling correlation: ' || {sg('rr', 3)}
           || ' — sentiment and price volatility are moving in conflict over the last 7 days' AS reason
    FROM (SELECT date, i, last_value(c IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rr FROM (
          SELECT date, row_number() OVER (ORDER BY date) AS i, CASE WHEN count(*) OVER o >= 3
                 THEN nullif({r('corr(volatility, avg_score) OVER o', 4)}, 'NaN'::DOUBLE) END AS c
          FROM trade_hist JOIN (SELECT date, avg_score FROM daily_sent) USING (date)
          WINDOW o AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)))
    WHERE i >= 8 AND rr <= -0.5"""

query("price_gap", with_("ee", gap_sql("ee")))(lambda s, d: N.price_gap(event_enriched(s, d)))
query("vol_regime", with_("trade_hist", VOLREG))(lambda s, d: N.vol_regime(trade_hist(s, d)))
query("breadth_extreme", with_("trade_hist", BREADTH))(lambda s, d: N.breadth_extreme(trade_hist(s, d)))
query("cluster_spike", with_("event_prices", cluster_sql("event_prices")))(lambda s, d: N.cluster_spike(S.event_prices(s, d)))
query("sent_vol_divergence", with_("trade_hist daily_sent", DIVERGE))(
    lambda s, d: N.sent_vol_divergence(trade_hist(s, d), SE.daily_sentiment(sentiment(s, d))))


def trade_anomalies(spark, sf):
    p, sent = S.trade_prices(spark, sf), sentiment(spark, sf)
    return N.all_anomalies(p, G.enrich(p), trade_hist(spark, sf), SE.daily_sentiment(sent))


ALL_ANOM = " UNION ALL ".join([gap_sql("te"), VOLREG, BREADTH, cluster_sql("trade_prices"), DIVERGE])
query("all_anomalies", with_("te trade_hist daily_sent", ALL_ANOM))(trade_anomalies)
query("anomaly_log", with_("te trade_hist daily_sent", f"""
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(z_score) DESC NULLS LAST, coalesce(symbol, ''), anomaly_type, reason)::INTEGER
           AS rank FROM ({ALL_ANOM})"""))(lambda s, d: G.log_order(trade_anomalies(s, d), "z_score", "anomaly_type"))
query("anomaly_summary", with_("te trade_hist daily_sent", f"""
    SELECT date, count(*) AS n_anomalies, count_if(severity = 'Critical')::BIGINT AS n_critical,
           count_if(severity = 'High')::BIGINT AS n_high FROM ({ALL_ANOM}) GROUP BY date"""))(
    lambda s, d: N.anomaly_summary(trade_anomalies(s, d)))

# --- forecasts -------------------------------------------------------------------------------------------------------
CTE["bdays"] = ((), """SELECT DATE '1990-01-01' + CAST(i AS INTEGER) AS bday, row_number() OVER (ORDER BY i) AS bn
    FROM range(20000) t(i) WHERE isodow(DATE '1990-01-01' + CAST(i AS INTEGER)) < 6""")


def forecast_sql(src: str, keys: str, value: str, method: str, horizon: int = 5) -> str:
    """``src`` is long (keys, date, value); every method works from rows numbered back from the newest."""
    on = " AND ".join(f"o.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    if method == "linear":
        fit = f"""
            SELECT g.*, greatest(sqrt((SELECT avg(pow(o.y - (g.a + g.b * o.x), 2)) FROM o WHERE {on} AND o.x > -31)), 1e-6) AS se FROM (
            SELECT {keys}, max(date) AS last, count(*)::DOUBLE AS n, avg(y) AS m, coalesce(stddev_samp(y), 0) AS sd,
                   regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM o WHERE x > -31 GROUP BY {keys}) g"""
        point = "CASE WHEN n < 3 THEN m ELSE a + b * (step - 1) END"
        margin = "CASE WHEN n < 3 THEN sd * sqrt(step) ELSE 1.96 * se * sqrt(step / n) END"
    else:
        fit = f"SELECT {keys}, max(date) AS last, avg(y) AS m, coalesce(stddev_samp(y), 0) AS sd, max(e) AS e FROM o WHERE x > -8 GROUP BY {keys}"
        point, margin = ("m" if method == "sma" else "e"), "sd * sqrt(step)"
    ema = f"last_value({ewm_sql('y', '(2.0::DOUBLE / 8)', keys)}) OVER (PARTITION BY {keys})"
    return f"""
        , s AS (SELECT {keys}, date, {value} AS y FROM {src} WHERE {value} IS NOT NULL),
        o0 AS (SELECT *, {ewm_sql('y', '(2.0::DOUBLE / 8)', keys)} AS e0,
                     -(row_number() OVER (PARTITION BY {keys} ORDER BY date DESC))::DOUBLE AS x FROM s),
        o AS (SELECT *, max(e0) FILTER (x = -1) OVER (PARTITION BY {keys}) AS e FROM o0),
        f AS ({fit})
        SELECT {keys}, bday AS date, {r(point, 4)} AS forecast, {r(f'({point}) - ({margin})', 4)} AS lower_bound,
               {r(f'({point}) + ({margin})', 4)} AS upper_bound, '{method}' AS method
        FROM (SELECT f.*, d.bday, (row_number() OVER (PARTITION BY {', '.join('f.' + k.strip() for k in keys.split(','))} ORDER BY d.bday))::DOUBLE AS step
              FROM f JOIN bdays d ON d.bday > f.last AND d.bday <= f.last + 20) WHERE step <= {horizon}"""


def fsql(needs: str, *a, **k) -> str:
    return with_(needs, forecast_sql(*a, **k)).replace(")\n\n        , s AS", "),\n s AS")


for m in ("sma", "ema", "linear"):
    query(f"forecast_{m}", fsql("trade_prices bdays", "trade_prices", "symbol", "price", m))(
        lambda s, d, m=m: FC.forecast_series(S.trade_prices(s, d), ["symbol"], "price", m))
query("business_days", with_("event_bars bdays", """
    SELECT symbol, last, bday FROM (SELECT symbol, last, bday, row_number() OVER (PARTITION BY symbol ORDER BY bday) AS k
        FROM (SELECT symbol, max(date) AS last FROM event_bars GROUP BY symbol) JOIN bdays ON bday > last AND bday < last + 30)
    WHERE k <= 7"""))(
    lambda s, d: S.event_bars(s, d).groupBy("symbol").agg(F.max("date").alias("last")).select(
        "symbol", "last", F.explode(FC.business_days(F.col("last"), 7)).alias("bday")))
CTE["metrics"] = (("trade_hist",), """
    SELECT date, 'avg_pct' AS metric, avg_pct AS value FROM trade_hist UNION ALL
    SELECT date, 'volatility', volatility FROM trade_hist UNION ALL SELECT date, 'breadth_pct', breadth_pct FROM trade_hist""")
query("forecast_metrics", fsql("metrics bdays", "metrics", "metric", "value", "linear"))(
    lambda s, d: FC.forecast_metrics(trade_hist(s, d)).drop("universe"))
CTE["sent_series"] = (("daily_sent",), "SELECT 'sentiment' AS metric, date, avg_score FROM daily_sent")
query("forecast_sentiment", fsql("sent_series bdays", "sent_series", "metric", "avg_score", "linear"))(
    lambda s, d: FC.forecast_sentiment(SE.daily_sentiment(sentiment(s, d))))
