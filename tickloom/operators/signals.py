"""Signal detectors and composite scores, for every date.

Each row's baseline is the symbol's history strictly before it, so filtering the
result to the newest date gives the daily answer and the rest is the back-test.
All detectors read one enriched frame, and the combined log is one pass over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom import config as cfg
from tickloom.functions import ladders, windows as W
from tickloom.functions.numeric import div, fixed, rnd, signed
from tickloom.operators.sentiment import with_asof_sentiment

SYM = ["symbol"]
c = F.col


def day_stats(prices: DataFrame) -> DataFrame:
    """Mean, deviation and running baseline volatility per (universe, date)."""
    g = prices.groupBy("universe", "date").agg(
        F.avg("pct_change").alias("mkt_avg"), F.stddev_samp("pct_change").alias("mkt_std"))
    base = F.avg(rnd(c("mkt_std"), 6)).over(W.before(["universe"]))
    return g.withColumn("baseline_vol", F.coalesce(F.when(base != 0, base), F.lit(cfg.BASELINE_VOL_DEFAULT)))


def enrich_sentiment(prices: DataFrame, sentiment: DataFrame) -> DataFrame:
    """The day's sentiment per symbol; on a day with no sentiment at all, the symbol's latest earlier one."""
    days = sentiment.select("date").distinct().withColumn("_has", F.lit(True))
    # On a day that has sentiment, the as-of row counts only when it is that very day's.
    use = c("_has").isNull() | (c("_last.sent_date") == c("date"))
    return with_asof_sentiment(prices, sentiment).join(days, "date", "left").select(
        *prices.columns, F.when(use, c("_last.sentiment_score")).alias("sentiment_score"),
        F.coalesce(F.when(use, c("_last.sentiment_label")), F.lit("No Data")).alias("sentiment_label"))


def enrich(prices: DataFrame, sentiment: DataFrame | None = None) -> DataFrame:
    base = enrich_sentiment(prices, sentiment) if sentiment is not None else prices.withColumn(
        "sentiment_score", F.lit(None).cast("double"))
    base = base.join(day_stats(prices), ["universe", "date"], "left")
    past, pct = W.before(SYM), c("pct_change")
    return base.select(
        "*", rnd(W.zscore(pct, W.trailing(SYM, cfg.SHORT_WINDOW)), 4).alias("z7"),
        F.row_number().over(W.ordered(SYM)).alias("rows_so_far"), F.count(pct).over(past).alias("hist_n"),
        F.avg(pct).over(past).alias("hist_mean"), F.stddev_samp(pct).over(past).alias("hist_std"),
        F.max("price").over(past).alias("hist_peak"))


def _signal(kind: str, direction: Column, strength: Column, score: Column, reason: Column) -> Column:
    return F.struct(c("symbol"), c("date"), F.lit(kind).alias("signal_type"), direction.alias("direction"),
                    strength.alias("strength"), score.alias("score"), reason.alias("reason"))


def _by_sign(x: Column) -> Column:
    return F.when(x >= 0, F.lit("Bullish")).otherwise(F.lit("Bearish"))


def breakout() -> tuple[Column, Column]:
    hit = (c("rows_so_far") >= cfg.MIN_SYMBOL_ROWS) & (F.abs("z7") >= cfg.BREAKOUT_Z)
    why = F.concat(c("symbol"), F.lit(" moved "), signed(c("pct_change"), 2), F.lit("% today — z-score "),
                   signed(c("z7"), 2), F.lit(f" vs {cfg.SHORT_WINDOW}-day history"))
    return hit, _signal("momentum_breakout", _by_sign(c("pct_change")), c("z7"), F.abs("z7"), why)


def volatility_spike() -> tuple[Column, Column]:
    base = c("baseline_vol")
    std = F.when(c("mkt_std") > 0, c("mkt_std")).otherwise(base)
    threshold = F.greatest(std, base) * cfg.VOL_SPIKE_RATIO
    size = F.abs("pct_change")
    score = rnd(size / F.greatest(std, F.lit(0.001)), 4)
    why = F.concat(c("symbol"), F.lit(" moved "), signed(c("pct_change"), 2), F.lit("% vs market threshold "),
                   fixed(threshold, 2), F.lit("% (ratio: "), fixed(score, 2), F.lit("x)"))
    return (base > 0) & (size >= threshold), _signal("volatility_spike", _by_sign(c("pct_change")), rnd(size, 4), score, why)


def sentiment_divergence() -> tuple[Column, Column]:
    pct, s = c("pct_change"), c("sentiment_score")
    up = (pct > cfg.SENT_DIVERGE_PRICE) & (s < -cfg.SENT_DIVERGE_MIN)
    down = (pct < -cfg.SENT_DIVERGE_PRICE) & (s > cfg.SENT_DIVERGE_MIN)
    head = F.when(up, F.lit(": price up ")).otherwise(F.lit(": price down "))
    tail = F.when(up, F.lit(" — price may be running ahead of news")).otherwise(F.lit(" — possible oversold opportunity"))
    why = F.concat(c("symbol"), head, signed(pct, 2), F.lit("% but sentiment "), signed(s, 4), tail)
    direction = F.when(up, F.lit("Bearish")).otherwise(F.lit("Bullish"))
    return up | down, _signal("sentiment_divergence", direction, rnd(F.abs(s), 4), rnd(F.abs(s) * F.abs(pct) / 100, 4), why)


def unusual_mover() -> tuple[Column, Column]:
    z = rnd(div(c("pct_change") - c("hist_mean"), c("hist_std")), 6)
    hit = (c("hist_n") >= cfg.MIN_SYMBOL_ROWS + 2) & (F.abs(z) >= cfg.UNUSUAL_Z)
    why = F.concat(c("symbol"), F.lit(" moved "), signed(c("pct_change"), 2), F.lit("% — z-score "), signed(z, 2),
                   F.lit(" vs full history (mean "), signed(c("hist_mean"), 2), F.lit("%, std "),
                   fixed(c("hist_std"), 2), F.lit("%)"))
    size = rnd(F.abs(z), 4)
    return hit, _signal("unusual_mover", F.when(z > 0, F.lit("Bullish")).otherwise(F.lit("Bearish")), size, size, why)


DETECTORS = {"momentum_breakout": breakout, "volatility_spike": volatility_spike,
             "sentiment_divergence": sentiment_divergence, "unusual_mover": unusual_mover}


def detect(enriched: DataFrame, kind: str) -> DataFrame:
    hit, row = DETECTORS[kind]()
    return enriched.where(hit).select(row.alias("_s")).select("_s.*")


def all_signals(enriched: DataFrame) -> DataFrame:
    """The four detectors in one pass: an array of the structs that fire, inlined."""
    fired = [F.when(hit, row) for hit, row in (d() for d in DETECTORS.values())]
    return enriched.select(F.inline(F.array_compact(F.array(*fired))))


def risk_scores(enriched: DataFrame) -> DataFrame:
    pct = c("pct_change")
    vol_ratio = F.abs(pct) / F.greatest(c("baseline_vol"), F.lit(0.001))
    z = F.when(c("hist_n") >= 3, F.abs((pct - c("hist_mean")) / F.greatest(c("hist_std"), F.lit(0.001)))).otherwise(F.lit(0.0))
    fall = (c("hist_peak") - c("price")) / F.greatest(c("hist_peak"), F.lit(0.001)) * 100
    drawdown = F.when(c("hist_peak").isNotNull(), F.greatest(F.lit(0.0), fall)).otherwise(F.lit(0.0))
    out = enriched.select("universe", "symbol", "date", vol_ratio.alias("_v"), z.alias("_z"), drawdown.alias("_d"))
    raw = rnd(c("_v") * 30 + c("_z") * 40 + c("_d") * 0.3, 2)
    score = F.when(raw > 100, F.lit(100.0)).otherwise(raw)  # ``least`` would turn a missing score into 100
    return out.select("universe", "symbol", "date", score.alias("risk_score"), ladders.risk_label(score).alias("risk_label"),
                      rnd(c("_v"), 4).alias("vol_ratio"), rnd(c("_z"), 4).alias("hist_z"), rnd(c("_d"), 4).alias("drawdown"))


def opportunities(enriched: DataFrame) -> DataFrame:
    pct = c("pct_change")
    z = F.when(c("hist_n") >= 3, (pct - c("hist_mean")) / F.greatest(c("hist_std"), F.lit(0.001))).otherwise(F.lit(0.0))
    sent = F.coalesce("sentiment_score", F.lit(0.0))
    out = enriched.select("universe", "symbol", "date", (pct - c("mkt_avg")).alias("_m"), z.alias("_z"), sent.alias("_s"))
    score = rnd(c("_m") * 0.4 + c("_z") * 0.4 + c("_s") * cfg.SENTIMENT_SCALE * 0.2, 4)
    return out.select("universe", "symbol", "date", score.alias("opportunity_score"),
                      ladders.opportunity_label(score).alias("opportunity_label"), rnd(c("_m"), 4).alias("rel_momentum"),
                      rnd(c("_z"), 4).alias("signal_z"), rnd(c("_s"), 4).alias("sentiment"))


def top_opportunities(opps: DataFrame, n: int = cfg.OPPORTUNITY_TOP) -> DataFrame:
    """The ``n`` strongest per day by absolute score."""
    w = Window.partitionBy("universe", "date").orderBy(F.abs("opportunity_score").desc(), "symbol")
    return opps.withColumn("rank", F.row_number().over(w)).where(c("rank") <= n)


def signal_summary(signals: DataFrame) -> DataFrame:
    return signals.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_active"), F.count_if(c("direction") == "Bullish").alias("n_bullish"),
        F.count_if(c("direction") == "Bearish").alias("n_bearish"))


def compute_all(prices: DataFrame, sentiment: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every signal view; each is a plan of its own over the one enriched frame."""
    e = enrich(prices, sentiment)
    opp = opportunities(e)
    return {**{k: detect(e, k) for k in DETECTORS}, "risk_scores": risk_scores(e), "opportunities": top_opportunities(opp),
            "all_signals": all_signals(e)}


def log_order(log: DataFrame, value: str, kind: str) -> DataFrame:
    """A day's log in reading order: ``rank`` 1 is the greatest |value|; then symbol (market-wide rows first), kind and reason."""
    day = Window.partitionBy("date").orderBy(F.abs(F.col(value)).desc_nulls_last(), F.coalesce("symbol", F.lit("")), kind, "reason")
    return log.withColumn("rank", F.row_number().over(day))
