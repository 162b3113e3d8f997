"""Anomaly detectors, for every date; baselines exclude the current row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom import config as cfg
from tickloom.functions import ladders, windows as W
from tickloom.functions.numeric import div, fixed, rnd, signed
from tickloom.schema import ANOMALIES

U = ["universe"]
c = F.col


def _row(df: DataFrame, kind: str, symbol: Column, severity: Column, z: Column, value: Column, reason: Column) -> DataFrame:
    return df.select("date", symbol.cast("string").alias("symbol"), F.lit(kind).alias("anomaly_type"),
                     severity.alias("severity"), rnd(z, 4).alias("z_score"), rnd(value, 4).alias("value"),
                     reason.alias("reason"))


def gap() -> tuple[Column, Column]:
    """Condition and row of a price gap, over columns of :func:`tickloom.operators.signals.enrich`."""
    z = rnd(div(c("pct_change") - c("hist_mean"), c("hist_std")), 6)
    hit = (c("hist_n") >= cfg.MIN_BASELINE) & (F.abs(z) >= cfg.PRICE_GAP_Z)
    why = F.concat(c("symbol"), F.lit(" moved "), signed(c("pct_change"), 2), F.lit("% — z-score "), signed(z, 2),
                   F.lit(" (mu="), signed(c("hist_mean"), 2), F.lit("%, sigma="), fixed(c("hist_std"), 2),
                   F.lit("%, n="), c("hist_n").cast("string"), F.lit(" days)"))
    return hit, F.struct("date", c("symbol").cast("string").alias("symbol"), F.lit("price_gap").alias("anomaly_type"),
                         ladders.severity(F.abs(z)).alias("severity"), rnd(z, 4).alias("z_score"), rnd(c("pct_change"), 4).alias("value"),
                         why.alias("reason"))


def price_gap(enriched: DataFrame) -> DataFrame:
    """``enriched`` comes from :func:`tickloom.operators.signals.enrich`."""
    hit, row = gap()
    return enriched.where(hit).select(row.alias("_r")).select("_r.*")


def _market(hist: DataFrame, metric: str, min_z: float) -> DataFrame:
    past, m = W.before(U), c(metric)
    # The current day counts towards the minimum history, so min - 1 earlier days are enough.
    d = hist.where(m.isNotNull()).select(
        "date", m.alias("_v"), F.row_number().over(W.ordered(U)).alias("_i"), F.avg(m).over(past).alias("_mu"),
        F.stddev_samp(m).over(past).alias("_sd"))
    d = d.withColumn("_z", rnd(div(c("_v") - c("_mu"), c("_sd")), 6))
    return d.where((c("_i") >= cfg.MIN_BASELINE) & (F.abs("_z") >= min_z))


def vol_regime(hist: DataFrame) -> DataFrame:
    hits = _market(hist, "volatility", cfg.VOL_REGIME_Z)
    word = F.when(c("_z") > 0, F.lit("above")).otherwise(F.lit("below"))
    why = F.concat(F.lit("Market volatility "), fixed(c("_v"), 4), F.lit("% is "), fixed(F.abs("_z"), 2),
                   F.lit(" std devs "), word, F.lit(" its historical mean (mu="), fixed(c("_mu"), 4),
                   F.lit("%, sigma="), fixed(c("_sd"), 4), F.lit("%)"))
    return _row(hits, "vol_regime", F.lit(None), ladders.severity(F.abs("_z")), c("_z"), c("_v"), why)


def breadth_extreme(hist: DataFrame) -> DataFrame:
    hits = _market(hist, "breadth_pct", cfg.BREADTH_Z)
    word = F.when(c("_z") > 0, F.lit("overbought")).otherwise(F.lit("oversold"))
    why = F.concat(F.lit("Market breadth "), fixed(c("_v"), 1), F.lit("% is historically "), word, F.lit(" (z="),
                   signed(c("_z"), 2), F.lit(", mu="), fixed(c("_mu"), 1), F.lit("%, sigma="), fixed(c("_sd"), 1), F.lit("%)"))
    return _row(hits, "breadth_extreme", F.lit(None), ladders.severity(F.abs("_z")), c("_z"), c("_v"), why)


def cluster_spike(prices: DataFrame) -> DataFrame:
    """Share of a day's symbols that moved far in one direction; at most two rows per day."""
    pct = c("pct_change")
    up, down = pct >= cfg.CLUSTER_MOVE, pct <= -cfg.CLUSTER_MOVE
    g = prices.groupBy("universe", "date").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(up).alias("_u"), F.count_if(down).alias("_d"),
        F.avg(F.when(up, pct)).alias("_ua"), F.avg(F.when(down, pct)).alias("_da"))

    def side(label, k, avg):
        return F.struct(F.lit(label).alias("label"), c(k).alias("k"), c(avg).alias("avg"), (c(k) / c("_n")).alias("share"))

    sides = g.select("date", "_n", F.inline(F.array(side("upside", "_u", "_ua"), side("downside", "_d", "_da"))))
    hits = sides.where(c("share") >= cfg.CLUSTER_SHARE)
    why = F.concat(c("k").cast("string"), F.lit(" of "), c("_n").cast("string"), F.lit(" stocks ("),
                   fixed(c("share") * 100, 0), F.lit("%) showed strong "), c("label"), F.lit(" moves (avg "),
                   signed(c("avg"), 2), F.lit("%) — coordinated macro-driven session"))
    return _row(hits, "cluster_spike", F.lit(None), ladders.cluster_severity(c("share")), c("share"), c("avg"), why)


def sent_vol_divergence(hist: DataFrame, daily_sent: DataFrame) -> DataFrame:
    """Days whose latest 7-day correlation of volatility and sentiment is strongly negative."""
    n = cfg.SHORT_WINDOW
    both = hist.select("universe", "date", "volatility").join(daily_sent.select("date", "avg_score"), "date")
    r = rnd(W.corr(c("volatility"), c("avg_score"), W.trailing(U, n), max(3, n // 2)), 4)
    d = both.select("universe", "date", r.alias("_r"), F.row_number().over(W.ordered(U)).alias("_i"))
    d = d.withColumn("_r", F.last("_r", ignorenulls=True).over(W.up_to(U)))
    hits = d.where((c("_i") >= n + 1) & (c("_r") <= cfg.SENT_VOL_CORR))
    why = F.concat(F.lit("Sentiment-volatility rolling correlation: "), signed(c("_r"), 3),
                   F.lit(" — sentiment and price volatility are moving in conflict over the last "
                         f"{n} days"))
    sev = F.when(c("_r") < -0.75, F.lit("High")).otherwise(F.lit("Moderate"))
    return _row(hits, "sent_vol_divergence", F.lit(None), sev, c("_r"), c("_r"), why)


def all_anomalies(prices: DataFrame, enriched: DataFrame, hist: DataFrame, daily_sent: DataFrame | None = None) -> DataFrame:
    out = price_gap(enriched).unionByName(vol_regime(hist)).unionByName(breadth_extreme(hist)).unionByName(
        cluster_spike(prices))
    if daily_sent is not None:
        out = out.unionByName(sent_vol_divergence(hist, daily_sent))
    return out.select(*ANOMALIES.fieldNames())


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_anomalies"), F.count_if(c("severity") == "Critical").alias("n_critical"),
        F.count_if(c("severity") == "High").alias("n_high"))
