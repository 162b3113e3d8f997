"""Feature frame, cross-asset alignment, and feature ranking and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom import config as cfg
from tickloom.functions import windows as W
from tickloom.functions.numeric import div, rnd
from tickloom.operators import comoments as M
from tickloom.operators.orderstats import quantiles
from tickloom.operators.preprocess import normalise

SYM = ["symbol"]
META = ["date", "symbol", "open", "high", "low", "close", "volume"]

# Feature order (fixed values): earlier features win in the correlation filter.
FEATURE_NAMES = (
    "returns_pct log_returns gap_pct intraday_range_pct sma_20 sma_50 ema_12 ema_26 price_vs_sma20 price_vs_sma50 "
    "sma_crossover rsi_14 macd macd_signal macd_hist momentum_10 signal_strength atr_14 volatility_21 bb_width "
    "atr_vs_sma20 drawdown_pct volume_sma_20 volume_ratio return_rolling_mean_7d return_rolling_std_7d "
    "return_rolling_skew_7d bb_pct_b adx_14 plus_di minus_di stochrsi_k stochrsi_d rsi_x_vol momentum_x_volume "
    "macd_x_bb price_vs_sma20_x_rsi returns_lag1 returns_lag2 returns_lag3 returns_lag4 returns_lag5 rsi_lag1 rsi_lag2 "
    "rsi_lag3 macd_hist_lag1 macd_hist_lag2 macd_hist_lag3"
).split()


def ratio_features(df: DataFrame) -> DataFrame:
    c = F.col

    def off(a, b):
        return rnd(div(a, b) - 1, 4)

    return (df.withColumn("price_vs_sma20", off(c("close"), c("sma_20")))
            .withColumn("price_vs_sma50", off(c("close"), c("sma_50")))
            .withColumn("sma_crossover", off(c("sma_20"), c("sma_50")))
            .withColumn("atr_vs_sma20", rnd(div(c("atr_14"), c("sma_20")), 4))
            .withColumn("volume_ratio", rnd(div(c("volume"), c("volume_sma_20")), 4)))


def interaction_features(df: DataFrame) -> DataFrame:
    c = F.col
    return (df.withColumn("rsi_x_vol", rnd(c("rsi_14") / 100 * c("volatility_21"), 4))
            .withColumn("momentum_x_volume", rnd(c("momentum_10") * c("volume_ratio"), 4))
            .withColumn("macd_x_bb", rnd(c("macd_hist") * c("bb_width"), 4))
            .withColumn("price_vs_sma20_x_rsi", rnd(c("price_vs_sma20") * ((c("rsi_14") - 50) / 50), 4)))


def lag_features(df: DataFrame) -> DataFrame:
    wo, w7, ret = W.ordered(SYM), W.trailing(SYM, cfg.SHORT_WINDOW), F.col("returns_pct")
    lags = [F.lag("returns_pct", k).over(wo).alias(f"returns_lag{k}") for k in range(1, 6)]
    for src, name in (("rsi_14", "rsi"), ("macd_hist", "macd_hist")):
        lags += [F.lag(src, k).over(wo).alias(f"{name}_lag{k}") for k in range(1, 4)]
    return df.select("*", *lags, rnd(W.mean(ret, w7), 4).alias("return_rolling_mean_7d"),
                     rnd(W.std(ret, w7), 4).alias("return_rolling_std_7d"),
                     rnd(W.skew(ret, w7), 4).alias("return_rolling_skew_7d"))


def feature_set(indicators: DataFrame, normalised: bool = False) -> DataFrame:
    """Metadata plus the ordered features, for all symbols; optionally z-normalised per symbol."""
    out = lag_features(interaction_features(ratio_features(indicators)))
    names = [c for c in FEATURE_NAMES if c in out.columns]
    out = out.select(*META, *names)
    if normalised:
        stats = out.groupBy(*SYM).agg(*[F.avg(c).alias(f"_m_{c}") for c in names],
                                      *[F.stddev_samp(c).alias(f"_s_{c}") for c in names])
        z = [F.when(F.col(f"_s_{c}") == 0, F.col(c) - F.col(f"_m_{c}")).otherwise(
            rnd(div(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), 6)).alias(c) for c in names]
        out = out.join(stats, SYM).select(*META, *z)
    return out


def cross_asset_wide(features: DataFrame, symbols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Dates x (symbol, feature) by one pivot with explicit values: one shuffle instead of a chain of outer joins."""
    wide = (features.where(F.col("symbol").isin(*symbols)).groupBy("date").pivot("symbol", list(symbols))
            .agg(*[F.first(n, ignorenulls=True).alias(n) for n in names]))
    if len(names) == 1:
        wide = wide.select("date", *[F.col(f"`{s}`").alias(f"{s}_{names[0]}") for s in symbols])
    return wide.select("date", *[F.col(f"`{s}_{n}`").alias(f"{s.upper()}_{n}") for s in symbols for n in names])


# --- mutual information ------------------------------------------------------------------------------------------------

def mutual_information(df: DataFrame, features: Sequence[str], target: str = "returns_pct",
                       n_bins: int = cfg.MI_BINS) -> DataFrame:
    """(feature, mutual_information) over complete rows.

    Quantile edges are exact and distributed; repeated edges collapse.  They are one row of features x (bins + 1) numbers, so every
    task gets them all and counts its rows into (feature, bin, bin) cells; only those counts are shuffled.
    """
    names = [f for f in features if f != target]
    whole = df.select(target, *names).dropna()
    every = whole.unpivot([], [target, *names], "feature", "x")
    cuts = [F.col(f"_e{i}") for i in range(n_bins + 1)]
    edges = quantiles(every, ["feature"], "x", [i / n_bins for i in range(n_bins + 1)], "_e").select(
        "feature", F.array_distinct(F.array(*cuts)).alias("_edges"))
    every_name = [target, *names]
    place = F.array_position(F.array(*[F.lit(n) for n in every_name]), F.col("feature"))
    row = edges.groupBy().agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), "_edges"))).alias("_all")).withColumn("_k", F.lit(1))
    with_edges = whole.withColumn("_k", F.lit(1)).join(F.broadcast(row), "_k")  # a global aggregate: exactly one row

    def bin_of(x: Column, own: Column) -> Column:
        """Right-closed bin, lowest value included."""
        return (F.greatest(F.size(F.filter(own["_edges"], lambda e: e < x)), F.lit(1)) - 1).cast("short")

    binned = with_edges.select(F.zip_with(F.array(*every_name), "_all", bin_of).alias("_b"))
    cells = binned.select(F.col("_b")[0].alias("_yb"), F.posexplode(F.slice("_b", 2, len(names))).alias("_f", "_xb"))
    joint = cells.groupBy("_f", "_xb", "_yb").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    total = F.sum("_n").over(W.whole(["_f"]))
    px, py = F.sum("_n").over(W.whole(["_f", "_xb"])), F.sum("_n").over(W.whole(["_f", "_yb"]))
    terms = joint.select("_f", (F.col("_n") / total).alias("_p"), (px / total * (py / total)).alias("_q"))
    mi = terms.groupBy("_f").agg(F.sum(F.col("_p") * F.log(F.col("_p") / F.col("_q"))).alias("_mi"))
    label = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("_f") + 1)
    return mi.select(label.alias("feature"), F.greatest(F.lit(0.0), rnd(F.col("_mi"), 6)).alias("mutual_information"))


# --- selection ---------------------------------------------------------------------------------------------------------

def _named(features: Sequence[str], i: Column) -> list[Column]:
    return [F.element_at(F.array(*[F.lit(f) for f in features]), i + 1).alias("feature"), (i + 1).cast("int").alias("position")]


def variance_filter(df: DataFrame, features: Sequence[str], minimum: float = cfg.MIN_VARIANCE) -> DataFrame:
    """(feature, position, variance, kept) over complete rows.

    Without a complete row everything is kept; with a single one no variance exists and nothing is.
    """
    v = M.variances(M.complete(M.comoments(df, features)), len(features))
    enough = F.coalesce(F.col("variance") >= minimum, F.lit(False))
    return v.select(*_named(features, F.col("i")), "variance", ((F.col("n") == 0) | enough).alias("kept"))


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson r of every ordered feature pair over complete rows."""
    r = M.correlations(M.complete(M.comoments(df, features)), len(features))
    label = F.array(*[F.lit(f) for f in features])
    return r.select("i", "j", F.element_at(label, F.col("i") + 1).alias("earlier"), F.element_at(label, F.col("j") + 1).alias("feature"),
                    rnd(F.col("r"), 6).alias("r"))


def correlation_filter(df: DataFrame, features: Sequence[str], cutoff: float = cfg.CORR_CUTOFF) -> DataFrame:
    """(feature, position, max_abs_r, kept): a feature goes when any earlier one, itself kept or not, is too close."""
    pairs = correlation_pairs(df, features)
    worst = pairs.groupBy("feature").agg(F.max(F.abs("r")).alias("max_abs_r"))
    names = df.sparkSession.createDataFrame([(f, i + 1) for i, f in enumerate(features)], "feature string, position int")
    return names.join(worst, "feature", "left").select(
        "feature", "position", "max_abs_r", F.coalesce(F.col("max_abs_r") < cutoff, F.lit(True)).alias("kept"))


def select_features(df: DataFrame, features: Sequence[str], cutoff: float = cfg.CORR_CUTOFF,
                    minimum: float = cfg.MIN_VARIANCE) -> DataFrame:
    """(feature, position) that pass the variance filter and then the correlation filter.

    The features that pass the first filter decide which rows are complete for the second.  Both read the same sums per pattern of missing
    values, so the rows are read once and nothing is fetched.
    """
    k = len(features)
    patterns = M.comoments(df, features)
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.col("n") == 0) | F.coalesce(
        (F.col("n") > 1) & (F.get("product", i * k + i) / (F.col("n") - 1) >= minimum), F.lit(False)))
    live = M.complete(patterns).select(spread.alias("wanted"))
    close = M.correlations(M.complete_over(patterns, live), k).where(F.abs(rnd(F.col("r"), 6)) >= cutoff)
    varied = live.select(F.posexplode("wanted").alias("i", "_live")).where("_live").select("i")
    gone = close.join(varied, "i", "left_semi").select(F.col("j").alias("i")).distinct()
    return varied.join(gone, "i", "left_anti").select(*_named(features, F.col("i")))


__all__ = ["FEATURE_NAMES", "feature_set", "cross_asset_wide", "mutual_information", "variance_filter",
           "correlation_filter", "select_features", "normalise"]
