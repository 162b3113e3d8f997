"""Plain-text briefings, one row per (universe, date), for every date.

All inputs are per-day tables, so the joins here are over days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom import config as cfg
from tickloom.functions import ladders, windows as W
from tickloom.functions.numeric import div, fixed, rnd, signed

U = ["universe"]
KEY = ["universe", "date"]
c, lit = F.col, F.lit

# Sentence parts (fixed values).
NO_SENTIMENT = "Sentiment data is not available for this session."
NO_SIGNALS = "No material signals detected in the current session."
NO_ANOMALIES = ("No statistical anomalies detected in the current session. "
                "Market conditions are within normal historical parameters.")
CONTAINED = "The universe is in a generally contained risk environment with no high-risk classifications."
FORECAST_NOTE = (" Note: projections are statistical extrapolations based on recent trends "
                 "and carry inherent uncertainty.")


def phrases(hist: DataFrame, trend: DataFrame) -> DataFrame:
    """The phrase of each ladder for every day; ``trend`` is the market indicator table."""
    z = div(c("volatility") - F.avg("volatility").over(W.before(U)), F.stddev_samp("volatility").over(W.before(U)))
    return (hist.select(*KEY, ladders.breadth_phrase(c("breadth_pct")).alias("breadth_phrase"),
                        ladders.momentum_phrase(c("avg_pct")).alias("momentum_phrase"),
                        ladders.vol_phrase(rnd(F.coalesce(z, lit(0.0)), 6)).alias("vol_phrase"))
            .join(trend.select(*KEY, ladders.trend_phrase(c("trend_7_30")).alias("trend_phrase")), KEY))


def session_summary(roll: DataFrame) -> DataFrame:
    """``roll`` is the per-day table with its rolling columns."""
    total = F.greatest(c("n_gainers") + c("n_losers") + c("n_flat"), lit(1))
    avg7 = signed(c("rolling_avg_7d"), 2)
    diff = rnd(c("avg_pct") - c("rolling_avg_7d"), 6)
    ctx = (F.when(F.row_number().over(W.ordered(U)) < 2, lit(""))
           .when(diff > 1.0, F.concat(lit(" This represents a notable improvement over the recent 7-day average of "), avg7, lit("%.")))
           .when(diff < -1.0, F.concat(lit(" This marks a deterioration from the recent 7-day average of "), avg7, lit("%.")))
           .otherwise(F.concat(lit(" This is broadly consistent with the recent 7-day average of "), avg7, lit("%."))))
    text = F.concat(
        lit("The session registered "), ladders.breadth_phrase(c("n_gainers") / total * 100), lit(" with "),
        c("n_gainers").cast("string"), lit(" of "), total.cast("string"), lit(" stocks advancing and "),
        c("n_losers").cast("string"), lit(" declining. The average move across the universe was "), signed(c("avg_pct"), 2),
        lit("%, reflecting "), ladders.momentum_phrase(c("avg_pct")), lit("."), ctx, lit(" The session was led by "),
        c("best_stock"), lit(" ("), signed(c("best_pct"), 2), lit("%), while "), c("worst_stock"),
        lit(" posted the sharpest decline at "), signed(c("worst_pct"), 2), lit("%."))
    return roll.select(*KEY, text.alias("session_summary"))


def volatility_text(hist: DataFrame) -> DataFrame:
    past, v = W.before(U), c("volatility")
    d = hist.select(*KEY, v, F.coalesce(F.avg(v).over(past), v).alias("_b"), F.stddev_samp(v).over(past).alias("_sd"),
                    F.count(v).over(past).alias("_k"), F.row_number().over(W.ordered(U)).alias("_i"),
                    F.last(v, ignorenulls=True).over(past).alias("_p"))
    sigma = F.when(c("_k") >= 4, c("_sd")).otherwise(lit(0.0))
    denom = F.when(c("_i") >= 5, F.greatest(sigma, lit(1e-6))).otherwise(F.greatest(c("_b") * 0.3, lit(1e-6)))
    z = rnd((v - c("_b")) / denom, 6)
    trend = (F.when(c("_k") < 2, lit("")).when(v > c("_p") * 1.1, lit(" The trend is accelerating."))
             .when(v < c("_p") * 0.9, lit(" The trend is decelerating.")).otherwise(lit(" The trend is stable.")))
    bare = F.concat(lit("Session volatility recorded at "), F.coalesce(fixed(v, 4), lit("nan")),
                    lit("% standard deviation. Insufficient history to contextualise against a baseline."))
    full = F.concat(lit("Intraday volatility is "), ladders.vol_phrase(z), lit(" (session std dev "), fixed(v, 4),
                    lit("% vs baseline "), fixed(c("_b"), 4), lit("%)."), trend)
    return d.select(*KEY, F.when(v.isNull() | c("_b").isNull() | (c("_b") <= 0), bare).otherwise(full).alias("volatility"))


def sentiment_text(breadth: DataFrame, daily: DataFrame) -> DataFrame:
    """``breadth`` is the per-date sentiment breadth, ``daily`` the per-date average score."""
    w = W.ordered(U)
    days = daily.select(lit("all").alias("universe"), "date", "avg_score")
    days = days.select("date", rnd(c("avg_score") - F.lag("avg_score").over(w), 9).alias("_delta"))
    d = breadth.join(days, "date", "left")
    trend = (F.when(c("_delta").isNull(), lit("")).when(c("_delta") > 0.03, lit(" Sentiment is improving from the prior session."))
             .when(c("_delta") < -0.03, lit(" Sentiment has deteriorated from the prior session."))
             .otherwise(lit(" Sentiment is broadly unchanged from the prior session.")))
    text = F.concat(
        lit("News sentiment across the 100-stock universe reflects "), ladders.sentiment_phrase(c("mean_score"), c("pct_bullish")),
        lit(". "), c("n_bullish").cast("string"), lit(" stocks carry a bullish news signal ("), fixed(c("pct_bullish"), 1),
        lit("%) against "), c("n_bearish").cast("string"), lit(" with a bearish signal ("), fixed(c("pct_bearish"), 1),
        lit("%). The mean sentiment score stands at "), signed(c("mean_score"), 4), lit(", consistent with a "), c("regime"),
        lit(" market regime."), trend)
    return d.select("date", text.alias("sentiment"), ladders.sentiment_phrase(c("mean_score"), c("pct_bullish")).alias("tone"))


def signal_text(signals: DataFrame) -> DataFrame:
    kind, sc = c("signal_type"), c("score")

    def top(name):
        return F.min(F.when(kind == name, F.struct((-sc).alias("k"), c("symbol").alias("s"), c("strength").alias("v"))))

    def n(cond):
        return F.count_if(cond)

    div_ = kind == "sentiment_divergence"
    g = signals.groupBy("date").agg(
        F.count(lit(1)).alias("n"), n(c("direction") == "Bullish").alias("bull"), n(c("direction") == "Bearish").alias("bear"),
        top("momentum_breakout").alias("bo"), top("volatility_spike").alias("vs"), n(kind == "volatility_spike").alias("n_vs"),
        n(div_).alias("n_sd"), n(div_ & (c("direction") == "Bullish")).alias("sd_bull"),
        n(div_ & (c("direction") == "Bearish")).alias("sd_bear"))

    def s(x):
        return c(x).cast("string")

    head = F.concat(lit("The signal engine identified "), s("n"), lit(" active signal(s) ("), s("bull"), lit(" bullish, "),
                    s("bear"), lit(" bearish)."))
    bo = F.when(c("bo").isNotNull(), F.concat(lit("The most significant momentum breakout is "), c("bo.s"),
                                              lit(" (signal strength z-score: "), signed(c("bo.v"), 2), lit(").")))
    vs = F.when(c("n_vs") > 0, F.concat(lit("Volatility spikes detected in "), s("n_vs"), lit(" stock(s), led by "), c("vs.s"),
                                        lit(" at "), fixed(c("vs.v"), 2), lit("%.")))
    sd = F.when(c("n_sd") > 0, F.concat(lit("Sentiment divergence detected in "), s("n_sd"), lit(" stock(s) ("), s("sd_bull"),
                                        lit(" bullish, "), s("sd_bear"), lit(" bearish).")))
    return g.select("date", F.concat_ws(" ", head, bo, vs, sd).alias("signals"), c("n").alias("n_signals"))


def anomaly_text(anomalies: DataFrame) -> DataFrame:
    worst = F.min(F.struct((-F.abs("z_score")).alias("k"), c("anomaly_type").alias("t"),
                           F.coalesce("symbol", lit("")).alias("s"), (-c("value")).alias("v"), c("reason").alias("r")))
    g = anomalies.groupBy("date").agg(
        F.count(lit(1)).alias("n"), F.count_if(c("severity") == "Critical").alias("crit"),
        F.count_if(c("severity") == "High").alias("high"), worst.alias("w"))
    sev = (F.when(c("crit") > 0, F.concat(c("crit").cast("string"), lit(" critical-severity event(s) require immediate attention.")))
           .when(c("high") > 0, F.concat(c("high").cast("string"), lit(" high-severity anomaly(ies) noted.")))
           .otherwise(lit("All detected anomalies are of moderate severity.")))
    text = F.concat(lit("The anomaly detection engine identified "), c("n").cast("string"),
                    lit(" statistical anomaly(ies). "), sev, lit(" Highest-priority event: "), c("w.r"))
    return g.select("date", text.alias("anomalies"), (c("crit") + c("high")).alias("n_priority"))


def risk_text(risk: DataFrame) -> DataFrame:
    g = risk.groupBy("date").agg(
        F.count(lit(1)).alias("n"), F.count_if(c("risk_label") == "High Risk").alias("hi"),
        F.count_if(c("risk_label") == "Medium Risk").alias("mid"), F.count_if(c("risk_label") == "Low Risk").alias("lo"),
        F.min(F.when(c("risk_score").isNotNull(), F.struct((-c("risk_score")).alias("k"), c("symbol").alias("s"),
                                                           c("risk_score").alias("v")))).alias("w"))

    def s(x):
        return c(x).cast("string")

    head = (F.when(c("hi") == 0, lit(CONTAINED))
            .when(c("hi") <= 5, F.concat(s("hi"), lit(" stock(s) flagged as high-risk out of "), s("n"),
                                         lit(" analysed. Risk is concentrated rather than systemic.")))
            .otherwise(F.concat(s("hi"), lit(" of "), s("n"), lit(" stocks classified as high-risk. Elevated risk is broad-based "
                                                                 "and warrants caution across the universe."))))
    text = F.concat(head, lit(" The highest composite risk score belongs to "), c("w.s"), lit(" (score: "), fixed(c("w.v"), 1),
                    lit("/100). Distribution: "), s("hi"), lit(" high, "), s("mid"), lit(" medium, "), s("lo"), lit(" low risk."))
    return g.select("date", text.alias("risk"))


def forecast_text(hist: DataFrame, horizon: int = cfg.HORIZON) -> DataFrame:
    """Projection sentence of every day from the line through its last 30 days."""
    w, wo = W.trailing(U, cfg.FIT_WINDOW), W.ordered(U)
    d = hist.select(*KEY, "avg_pct", "volatility", "breadth_pct", F.row_number().over(wo).cast("double").alias("_x"))

    def ahead(metric, step):
        y, x = c(metric), c("_x")
        line = F.regr_intercept(y, x).over(w) + F.regr_slope(y, x).over(w) * (x + step)
        return rnd(F.when(F.count(y).over(w) < 3, F.avg(y).over(w)).otherwise(line), 4)

    d = d.select(*KEY, ahead("avg_pct", 1).alias("_f1"), ahead("avg_pct", horizon).alias("_fn"),
                 ahead("volatility", 1).alias("_v"), ahead("breadth_pct", 1).alias("_b"))
    word = F.when(c("_f1") >= 0, lit("positive")).otherwise(lit("negative"))
    text = F.concat_ws(
        " ", F.concat(lit(f"The {horizon}-day average % change projection end-point is "), signed(c("_fn"), 2),
                      lit("% with a near-term bias toward "), word, lit(" territory ("), signed(c("_f1"), 2), lit("% next session).")),
        F.concat(lit("Projected volatility for the next session: "), fixed(c("_v"), 4), lit("%.")),
        F.concat(lit("Breadth forecast for the next session: "), fixed(c("_b"), 1), lit("% advancing.")))
    return d.select(*KEY, F.concat(text, lit(FORECAST_NOTE)).alias("forecast"))


def daily_briefing(roll: DataFrame, breadth: DataFrame, daily_sent: DataFrame, signals: DataFrame, anomalies: DataFrame,
                   risk: DataFrame) -> DataFrame:
    """All sections plus the executive summary, one row per day."""
    hist = roll.select(*KEY, "avg_pct", "volatility", "breadth_pct", "n_gainers", "n_losers", "n_flat")
    out = (session_summary(roll).join(volatility_text(hist), KEY).join(forecast_text(hist), KEY).join(
        hist.select(*KEY, "avg_pct", "n_gainers", "n_losers", "n_flat"), KEY))
    for part in (sentiment_text(breadth, daily_sent), signal_text(signals), anomaly_text(anomalies), risk_text(risk)):
        out = out.join(part, "date", "left")
    share = c("n_gainers") / F.greatest(c("n_gainers") + c("n_losers") + c("n_flat"), lit(1)) * 100
    regime = F.when(share >= cfg.BREADTH_BULL, lit("bullish")).when(share <= cfg.BREADTH_BEAR, lit("bearish")).otherwise(lit("mixed"))
    tone = F.coalesce("tone", lit(ladders.SENTIMENT_PHRASES[-1]))
    summary = F.concat(
        lit("The session reflected a "), regime, lit(" market environment with "), fixed(share, 0),
        lit("% of active stocks advancing and a universe average move of "), signed(c("avg_pct"), 2),
        lit("%; news sentiment registered "), tone, lit(". The intelligence layer identified "),
        F.coalesce("n_signals", lit(0)).cast("string"), lit(" active signal(s) and "),
        F.coalesce("n_priority", lit(0)).cast("string"), lit(" high-priority anomaly(ies) requiring monitoring."))
    return out.select(
        *KEY, "session_summary", "volatility", F.coalesce("sentiment", lit(NO_SENTIMENT)).alias("sentiment"),
        F.coalesce("signals", lit(NO_SIGNALS)).alias("signals"), F.coalesce("anomalies", lit(NO_ANOMALIES)).alias("anomalies"),
        F.coalesce("risk", lit("Risk scoring data is unavailable.")).alias("risk"), "forecast", summary.alias("executive_summary"))
