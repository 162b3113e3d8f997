"""Threshold ladders that turn a number into a label."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickloom import config as cfg


def ladder(steps, otherwise: str) -> Column:
    """First true condition wins; NULL comparisons fall through to ``otherwise``."""
    (first_cond, first_label), *rest = steps
    out = F.when(first_cond, F.lit(first_label))
    for cond, label in rest:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def status(change: Column) -> Column:
    return ladder([(change > 0, "Gainer"), (change < 0, "Loser")], "Flat")


def price_tier(price: Column) -> Column:
    """Right-closed tiers; a price outside every tier is NULL."""
    edges, out = cfg.TIER_EDGES, None
    for lo, hi, label in zip(edges, edges[1:], cfg.TIER_LABELS):
        cond = (price > lo) & (price <= hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def breadth_regime(breadth: Column) -> Column:
    return ladder([(breadth >= cfg.BREADTH_BULL, "Bullish"), (breadth <= cfg.BREADTH_BEAR, "Bearish")], "Mixed")


def breadth_label(breadth: Column) -> Column:
    names = ("broad advance", "moderate advance", "mixed session", "moderate decline")
    return ladder([(breadth >= v, s) for v, s in zip(cfg.BREADTH_LADDER, names)], "broad decline")


def vol_regime(ratio: Column) -> Column:
    return ladder(
        [(ratio >= cfg.VOL_ELEVATED, "Elevated"), (ratio >= cfg.VOL_SLIGHTLY_HIGH, "Slightly High"),
         (ratio >= cfg.VOL_NORMAL_LOW, "Normal")], "Suppressed")


def vol_label(std: Column, baseline: Column) -> Column:
    ratio = F.try_divide(std, baseline)
    named = ladder(
        [(ratio >= cfg.VOL_ELEVATED, "elevated volatility"),
         (ratio >= cfg.VOL_SLIGHTLY_HIGH, "slightly elevated volatility"),
         (ratio >= cfg.VOL_NORMAL_LOW, "normal volatility")], "suppressed volatility")
    return F.when(baseline.isNull() | (baseline == 0), F.lit("indeterminate volatility")).otherwise(named)


def adaptive_regime(rank: Column) -> Column:
    return ladder([(rank >= cfg.REGIME_BULL_RANK, "Bullish"), (rank <= cfg.REGIME_BEAR_RANK, "Bearish")], "Mixed")


def trend(short: Column, long: Column, threshold: float = cfg.TREND_GAP) -> Column:
    gap = F.try_divide(short - long, F.abs(long))
    return ladder([(gap > threshold, "Bullish"), (gap < -threshold, "Bearish")], "Neutral")


def sentiment_label(score: Column) -> Column:
    return ladder([(score.isNull(), "No Data"), (score >= cfg.BULLISH_SCORE, "Bullish"),
                   (score <= cfg.BEARISH_SCORE, "Bearish")], "Neutral")


def sentiment_regime(mean: Column, pct_bull: Column, pct_bear: Column) -> Column:
    return ladder(
        [((pct_bull >= cfg.BREADTH_BULL) & (mean >= cfg.BULLISH_SCORE), "Risk-On — broad bullish news flow"),
         ((pct_bear >= cfg.BREADTH_BULL) & (mean <= cfg.BEARISH_SCORE), "Risk-Off — broad bearish news flow"),
         (mean >= cfg.BULLISH_SCORE, "Cautiously Bullish — marginal positive tone"),
         (mean <= cfg.BEARISH_SCORE, "Cautiously Bearish — marginal negative tone")],
        "Neutral — no dominant news direction")


def corr_strength(rho: Column) -> Column:
    a = F.abs(rho)
    return ladder([(rho.isNull(), "undefined"), (a < 0.1, "negligible"), (a < 0.3, "weak"), (a < 0.5, "moderate")],
                  "strong")


def corr_direction(rho: Column) -> Column:
    return ladder([(rho < 0, "negative"), (rho >= 0, "positive")], "undefined")


def severity(abs_z: Column) -> Column:
    return ladder([(abs_z >= cfg.SEVERITY_CRITICAL, "Critical"), (abs_z >= cfg.SEVERITY_HIGH, "High")], "Moderate")


def cluster_severity(share: Column) -> Column:
    return ladder([(share >= 0.60, "Critical"), (share >= 0.45, "High")], "Moderate")


def risk_label(score: Column) -> Column:
    return ladder([(score >= 70, "High Risk"), (score >= 40, "Medium Risk")], "Low Risk")


def opportunity_label(score: Column) -> Column:
    return ladder([(score > 1.0, "Strong Buy Signal"), (score > 0.3, "Moderate Opportunity"),
                   (score < -1.0, "Strong Sell Signal"), (score < -0.3, "Moderate Risk")], "Neutral")


def session_word(gain: Column, loss: Column) -> Column:
    return ladder([(gain > loss, "Bullish"), (loss > gain, "Bearish")], "Mixed")


def skew_word(skew: Column) -> Column:
    return ladder([(skew > 1, "right-skewed"), (skew < -1, "left-skewed")], "roughly balanced")


def momentum_word(gain: Column, loss: Column) -> Column:
    return ladder([(gain > loss, "risk-on"), (loss > gain, "risk-off")], "balanced")


# Narrative phrases (fixed values)
BREADTH_PHRASES = ("a broad-based advance", "a moderately positive session", "a mixed market session",
                   "a moderately negative session", "a broad-based decline")
VOL_PHRASES = ("severely elevated relative to recent history", "elevated above recent norms",
               "slightly above average", "in line with recent history",
               "below recent averages — a calm session", "suppressed — unusually quiet conditions")
MOMENTUM_PHRASES = ("strong positive momentum across the universe", "positive momentum", "marginal positive drift",
                    "marginal negative drift", "negative momentum", "strong negative momentum across the universe")
SENTIMENT_PHRASES = ("risk-on — broad bullish news tone", "risk-off — broad bearish news tone",
                     "cautiously bullish news tone", "cautiously bearish news tone", "a neutral news environment")


def breadth_phrase(breadth: Column) -> Column:
    return ladder([(breadth >= v, s) for v, s in zip(cfg.BREADTH_LADDER, BREADTH_PHRASES)], BREADTH_PHRASES[-1])


def vol_phrase(z: Column) -> Column:
    return ladder([(z > v, s) for v, s in zip(cfg.VOL_PHRASE_Z, VOL_PHRASES)], VOL_PHRASES[-1])


def momentum_phrase(avg_pct: Column) -> Column:
    return ladder([(avg_pct > v, s) for v, s in zip(cfg.MOMENTUM_PHRASE, MOMENTUM_PHRASES)], MOMENTUM_PHRASES[-1])


def sentiment_phrase(mean: Column, pct_bull: Column) -> Column:
    bull, bear = mean >= cfg.BULLISH_SCORE, mean <= cfg.BEARISH_SCORE
    conds = ((pct_bull >= cfg.BREADTH_BULL) & bull, (pct_bull <= cfg.RISK_OFF_BULL_PCT) & bear, bull, bear)
    return ladder(list(zip(conds, SENTIMENT_PHRASES)), SENTIMENT_PHRASES[-1])


def trend_phrase(label: Column) -> Column:
    return ladder([(label == "Bullish", "upward trending"), (label == "Bearish", "downward trending"),
                   (label == "Neutral", "range-bound")], "indeterminate")


def severity_phrase(label: Column) -> Column:
    return ladder([(label == "Critical", "a critical"), (label == "High", "a high-severity"),
                   (label == "Moderate", "a moderate")], "an")
