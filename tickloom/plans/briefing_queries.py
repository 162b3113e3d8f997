"""Briefing text queries."""

from __future__ import annotations

from tickloom.functions import ladders as L
from tickloom.operators import anomalies as N, briefing as B, daily as D, indicators as I, sentiment as SE, signals as G
from tickloom.plans.detector_queries import ALL_ANOM, ALL_SIGNALS, RISK, fx, sentiment, sg, trade_anomalies, trade_enriched
from tickloom.plans.market import event_hist, trade_hist, trade_roll
from tickloom.plans.registry import query
from tickloom.plans.sqlviews import CTE, r, w, with_
from tickloom.plans.symbols import MARKET
from tickloom.plans.table_queries import SB
from tickloom.sources import sample as S


def case(x: str, op: str, cuts, words) -> str:
    return "CASE " + " ".join(f"WHEN {x} {op} {v} THEN '{s}'" for v, s in zip(cuts, words)) + f" ELSE '{words[-1]}' END"


def breadth_words(x: str) -> str:
    return case(x, ">=", (70, 55, 45, 30), L.BREADTH_PHRASES)


def mom_words(x: str) -> str:
    return case(x, ">", (3.0, 1.0, 0.0, -1.0, -3.0), L.MOMENTUM_PHRASES)


def vol_words(x: str) -> str:
    return case(x, ">", (2.5, 1.5, 0.5, -0.5, -1.5), L.VOL_PHRASES)


def tone_words(m: str, p: str) -> str:
    s = L.SENTIMENT_PHRASES
    return (f"CASE WHEN {p} >= 60 AND {m} >= 0.05 THEN '{s[0]}' WHEN {p} <= 30 AND {m} <= -0.05 THEN '{s[1]}' "
            f"WHEN {m} >= 0.05 THEN '{s[2]}' WHEN {m} <= -0.05 THEN '{s[3]}' ELSE '{s[4]}' END")


PREV = "(ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ZP = f"(volatility - avg(volatility) OVER {PREV}) / nullif(stddev_samp(volatility) OVER {PREV}, 0)"
query("phrases", with_("trade_hist", f"""
    SELECT date, {breadth_words('breadth_pct')} AS breadth_phrase, {mom_words('avg_pct')} AS momentum_phrase,
           {vol_words(r(f'coalesce({ZP}, 0.0)', 6))} AS vol_phrase, CASE trend_7_30 WHEN 'Bullish' THEN 'upward trending'
           WHEN 'Bearish' THEN 'downward trending' WHEN 'Neutral' THEN 'range-bound' ELSE 'indeterminate' END AS trend_phrase
    FROM trade_hist JOIN (SELECT date, trend_7_30 FROM ({MARKET})) USING (date)"""))(
    lambda s, d: B.phrases(trade_hist(s, d), I.market_indicators(trade_hist(s, d))).drop("universe"))


def session_sql(roll: str) -> str:
    gap = r("avg_pct - rolling_avg_7d", 6)
    avg7 = sg("rolling_avg_7d", 2)
    return f"""
        SELECT date, 'The session registered ' || {breadth_words('g / t * 100')} || ' with ' || g || ' of ' || t || ' stocks advancing and '
               || l || ' declining. The average move across the universe was ' || {sg('avg_pct', 2)} || '%, reflecting '
               || {mom_words('avg_pct')} || '.' || CASE WHEN i < 2 THEN ''
               WHEN {gap} > 1.0 THEN ' This represents a notable improvement over the recent 7-day average of ' || {avg7} || '%.'
               WHEN {gap} < -1.0 THEN ' This marks a deterioration from the recent 7-day average of ' || {avg7} || '%.'
               ELSE ' This is broadly consistent with the recent 7-day average of ' || {avg7} || '%.' END
               || ' The session was led by ' || best_stock || ' (' || {sg('best_pct', 2)} || '%), while ' || worst_stock
               || ' posted the sharpest decline at ' || {sg('worst_pct', 2)} || '%.' AS session_summary
        FROM (SELECT *, n_gainers AS g, n_losers AS l, greatest(n_gainers + n_losers + n_flat, 1) AS t,
                     row_number() OVER (ORDER BY date) AS i FROM {roll})"""


def vol_sql(hist: str) -> str:
    zv = r("(volatility - b) / CASE WHEN i >= 5 THEN greatest(CASE WHEN k >= 4 THEN sd ELSE 0.0 END, 1e-6) ELSE greatest(b * 0.3, 1e-6) END", 6)
    return f"""
        SELECT date, CASE WHEN volatility IS NULL OR b IS NULL OR b <= 0 THEN 'Session volatility recorded at '
               || coalesce({fx('volatility', 4)}, 'nan') || '% standard deviation. Insufficient history to contextualise against a baseline.'
               ELSE 'Intraday volatility is ' || {vol_words(zv)} || ' (session std dev ' || {fx('volatility', 4)} || '% vs baseline '
               || {fx('b', 4)} || '%).' || CASE WHEN k < 2 THEN '' WHEN volatility > p * 1.1 THEN ' The trend is accelerating.'
               WHEN volatility < p * 0.9 THEN ' The trend is decelerating.' ELSE ' The trend is stable.' END END AS volatility
        FROM (SELECT date, volatility, coalesce(avg(volatility) OVER o, volatility) AS b, stddev_samp(volatility) OVER o AS sd,
                     count(volatility) OVER o AS k, row_number() OVER (ORDER BY date) AS i,
                     last_value(volatility IGNORE NULLS) OVER o AS p FROM {hist} WINDOW o AS {PREV})"""


SENT_TEXT = f"""
    SELECT date, {tone_words('mean_score', 'pct_bullish')} AS tone,
           'News sentiment across the 100-stock universe reflects ' || {tone_words('mean_score', 'pct_bullish')} || '. ' || n_bullish
           || ' stocks carry a bullish news signal (' || {fx('pct_bullish', 1)} || '%) against ' || n_bearish
           || ' with a bearish signal (' || {fx('pct_bearish', 1)} || '%). The mean sentiment score stands at '
           || {sg('mean_score', 4)} || ', consistent with a ' || regime || ' market regime.'
           || CASE WHEN dl IS NULL THEN '' WHEN dl > 0.03 THEN ' Sentiment is improving from the prior session.'
              WHEN dl < -0.03 THEN ' Sentiment has deteriorated from the prior session.'
              ELSE ' Sentiment is broadly unchanged from the prior session.' END AS sentiment
    FROM ({SB}) LEFT JOIN (SELECT date, {r('avg_score - lag(avg_score) OVER (ORDER BY date)', 9)} AS dl FROM daily_sent) USING (date)"""
SIG_TEXT = f"""
    SELECT date, n AS n_signals, concat_ws(' ', 'The signal engine identified ' || n || ' active signal(s) (' || u || ' bullish, ' || b || ' bearish).',
           CASE WHEN bs IS NOT NULL THEN 'The most significant momentum breakout is ' || bs || ' (signal strength z-score: ' || {sg('bv', 2)} || ').' END,
           CASE WHEN nv > 0 THEN 'Volatility spikes detected in ' || nv || ' stock(s), led by ' || vs || ' at ' || {fx('vv', 2)} || '%.' END,
           CASE WHEN ns > 0 THEN 'Sentiment divergence detected in ' || ns || ' stock(s) (' || su || ' bullish, ' || sb || ' bearish).' END) AS signals
    FROM (SELECT date, count(*) AS n, count_if(direction = 'Bullish')::BIGINT AS u, count_if(direction = 'Bearish')::BIGINT AS b,
        first(symbol ORDER BY score DESC, symbol) FILTER (signal_type = 'momentum_breakout') AS bs,
        first(strength ORDER BY score DESC, symbol) FILTER (signal_type = 'momentum_breakout') AS bv,
        first(symbol ORDER BY score DESC, symbol) FILTER (signal_type = 'volatility_spike') AS vs,
        first(strength ORDER BY score DESC, symbol) FILTER (signal_type = 'volatility_spike') AS vv,
        count_if(signal_type = 'volatility_spike')::BIGINT AS nv, count_if(signal_type = 'sentiment_divergence')::BIGINT AS ns,
        count_if(signal_type = 'sentiment_divergence' AND direction = 'Bullish')::BIGINT AS su,
        count_if(signal_type = 'sentiment_divergence' AND direction = 'Bearish')::BIGINT AS sb FROM ({ALL_SIGNALS}) GROUP BY date)"""
ANOM_TEXT = f"""
    SELECT date, crit + high AS n_priority, 'The anomaly detection engine identified ' || n || ' statistical anomaly(ies). '
           || CASE WHEN crit > 0 THEN crit || ' critical-severity event(s) require immediate attention.'
              WHEN high > 0 THEN high || ' high-severity anomaly(ies) noted.' ELSE 'All detected anomalies are of moderate severity.' END
           || ' Highest-priority event: ' || reason AS anomalies
    FROM (SELECT date, count(*) AS n, count_if(severity = 'Critical')::BIGINT AS crit, count_if(severity = 'High')::BIGINT AS high,
                 first(reason ORDER BY abs(z_score) DESC, anomaly_type, coalesce(symbol, ''), value DESC) AS reason FROM ({ALL_ANOM}) GROUP BY date)"""


def risk_sql(src: str) -> str:
    return f"""
        SELECT date, CASE WHEN hi = 0 THEN '{B.CONTAINED}' WHEN hi <= 5 THEN hi || ' stock(s) flagged as high-risk out of ' || n
               || ' analysed. Risk is concentrated rather than systemic.' ELSE hi || ' of ' || n || ' stocks classified as high-risk. '
               || 'Elevated risk is broad-based and warrants caution across the universe.' END
               || ' The highest composite risk score belongs to ' || s || ' (score: ' || {fx('v', 1)} || '/100). Distribution: '
               || hi || ' high, ' || mid || ' medium, ' || lo || ' low risk.' AS risk
        FROM (SELECT date, count(*) AS n, count_if(risk_label = 'High Risk')::BIGINT AS hi, count_if(risk_label = 'Medium Risk')::BIGINT AS mid,
                     count_if(risk_label = 'Low Risk')::BIGINT AS lo, first(symbol ORDER BY risk_score DESC, symbol) AS s,
                     max(risk_score) AS v FROM ({RISK.format(src=src)}) GROUP BY date)"""


def ahead(m: str, h: int) -> str:
    return r(f"CASE WHEN count({m}) OVER o < 3 THEN avg({m}) OVER o ELSE regr_intercept({m}, x) OVER o + regr_slope({m}, x) OVER o * (x + {h}) END", 4)


def forecast_text_sql(hist: str) -> str:
    return f"""
        SELECT date, 'The 5-day average % change projection end-point is ' || {sg('fn', 2)} || '% with a near-term bias toward '
               || CASE WHEN f1 >= 0 THEN 'positive' ELSE 'negative' END || ' territory (' || {sg('f1', 2)} || '% next session). '
               || 'Projected volatility for the next session: ' || {fx('fv', 4)} || '%. Breadth forecast for the next session: '
               || {fx('fb', 1)} || '% advancing.' || '{B.FORECAST_NOTE}' AS forecast
        FROM (SELECT date, {ahead('avg_pct', 1)} AS f1, {ahead('avg_pct', 5)} AS fn, {ahead('volatility', 1)} AS fv,
                     {ahead('breadth_pct', 1)} AS fb FROM (SELECT *, (row_number() OVER (ORDER BY date))::DOUBLE AS x FROM {hist})
              WINDOW o AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


query("session_summary", with_("event_roll", session_sql("event_roll")))(
    lambda s, d: B.session_summary(D.rolling_intelligence(event_hist(s, d))).drop("universe"))
query("volatility_text", with_("event_hist", vol_sql("event_hist")))(
    lambda s, d: B.volatility_text(event_hist(s, d)).drop("universe"))
query("sentiment_text", with_("sentiment daily_sent", SENT_TEXT))(
    lambda s, d: B.sentiment_text(SE.sentiment_breadth(sentiment(s, d), ["date"]), SE.daily_sentiment(sentiment(s, d))))
query("signal_text", with_("te", SIG_TEXT))(lambda s, d: B.signal_text(G.all_signals(trade_enriched(s, d))))
query("anomaly_text", with_("te trade_hist daily_sent", ANOM_TEXT))(lambda s, d: B.anomaly_text(trade_anomalies(s, d)))
query("risk_text", with_("te", risk_sql("te")))(lambda s, d: B.risk_text(G.risk_scores(trade_enriched(s, d))))
query("forecast_text", with_("event_hist", forecast_text_sql("event_hist")))(
    lambda s, d: B.forecast_text(event_hist(s, d)).drop("universe"))


def briefing(spark, sf):
    roll, sent = trade_roll(spark, sf), sentiment(spark, sf)
    prices, enriched, daily = S.trade_prices(spark, sf), trade_enriched(spark, sf), SE.daily_sentiment(sent)
    anomalies = N.all_anomalies(prices, enriched, trade_hist(spark, sf), daily)
    return B.daily_briefing(roll, SE.sentiment_breadth(sent, ["date"]), daily, G.all_signals(enriched), anomalies,
                            G.risk_scores(enriched)).drop("universe")


share = "n_gainers / greatest(n_gainers + n_losers + n_flat, 1) * 100"
query("daily_briefing", with_("te trade_roll sentiment daily_sent", f"""
    SELECT date, session_summary, v.volatility, coalesce(s.sentiment, '{B.NO_SENTIMENT}') AS sentiment,
           coalesce(g.signals, '{B.NO_SIGNALS}') AS signals, coalesce(a.anomalies, '{B.NO_ANOMALIES}') AS anomalies,
           coalesce(k.risk, 'Risk scoring data is unavailable.') AS risk, f.forecast,
           'The session reflected a ' || CASE WHEN {share} >= 60 THEN 'bullish' WHEN {share} <= 40 THEN 'bearish' ELSE 'mixed' END
           || ' market environment with ' || {fx(share, 0)} || '% of active stocks advancing and a universe average move of '
           || {sg('avg_pct', 2)} || '%; news sentiment registered ' || coalesce(s.tone, 'a neutral news environment')
           || '. The intelligence layer identified ' || coalesce(g.n_signals, 0) || ' active signal(s) and ' || coalesce(a.n_priority, 0)
           || ' high-priority anomaly(ies) requiring monitoring.' AS executive_summary
    FROM trade_hist h JOIN ({session_sql('trade_roll')}) ss USING (date) JOIN ({vol_sql('trade_hist')}) v USING (date)
    JOIN ({forecast_text_sql('trade_hist')}) f USING (date) LEFT JOIN ({SENT_TEXT}) s USING (date)
    LEFT JOIN ({SIG_TEXT}) g USING (date) LEFT JOIN ({ANOM_TEXT}) a USING (date) LEFT JOIN ({risk_sql('te')}) k USING (date)"""))(briefing)
