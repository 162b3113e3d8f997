"""Data-quality rules: each table is aggregated once and the counts become tidy (check, severity, n_bad) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tickloom import config as cfg
from tickloom.functions import windows as W
from tickloom.functions.numeric import div, rnd

c = F.col
Rule = tuple[str, Column, Column | str]  # name, bad count, severity when the count is not zero


def _tidy(row: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    items = F.array(*[
        F.struct(F.lit(n).alias("check"), F.when(bad > 0, sev).otherwise(F.lit("ok")).alias("severity"),
                 F.coalesce(bad, F.lit(0)).cast("long").alias("n_bad")) for n, bad, sev in rules])
    return row.select(*keep, F.inline(items))


WARN, ERR = "warning", "error"


def dq_prices(prices: DataFrame) -> DataFrame:
    """Nulls, bounds, repeated keys and the newest day's row count.

    Counts are merged per (date, symbol), then per date, then overall, so repeated keys need no distinct expansion.
    """
    flags = {"null_symbol": c("symbol").isNull(), "null_price": c("price").isNull(), "null_change": c("change").isNull(),
             "null_pct_change": c("pct_change").isNull(), "price_below_min": c("price") < cfg.MIN_PRICE,
             "price_above_max": c("price") > cfg.MAX_PRICE}
    key = prices.groupBy("date", "symbol").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(v).alias(k) for k, v in flags.items()])
    day = key.groupBy("date").agg(F.sum("n").alias("n"), F.sum(c("n") - 1).alias("dup"), *[F.sum(k).alias(k) for k in flags])
    row = day.agg(F.sum("n").alias("n"), F.sum("dup").alias("dup"), F.max_by("n", "date").alias("latest"),
                  *[F.sum(k).alias(k) for k in flags])
    dup_sev = F.when(c("dup") / c("n") > cfg.MAX_DUPLICATE_RATE, ERR).otherwise(WARN)
    rules = [(k, c(k), WARN) for k in flags] + [
        ("duplicate_keys", c("dup"), dup_sev),
        ("latest_day_rows_missing", F.greatest(cfg.MIN_ROWS_PER_DAY - c("latest"), F.lit(0)), WARN)]
    return _tidy(row, rules)


def dq_sentiment(s: DataFrame) -> DataFrame:
    score, label = c("sentiment_score"), c("sentiment_label")
    known = label.isin("Bullish", "Bearish", "Neutral", "No Data")
    key = s.groupBy("date", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((score < -1) | (score > 1)).alias("range"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("label"))
    row = key.agg(F.sum("range").alias("range"), F.sum("label").alias("label"), F.sum(c("n") - 1).alias("dup"))
    return _tidy(row, [("score_out_of_range", c("range"), WARN), ("unknown_label", c("label"), WARN),
                       ("duplicate_keys", c("dup"), WARN)])


def _num(x: str) -> Column:
    v = c(x).try_cast("double")
    return F.when(~F.isnan(v), v)


def dq_forecast(f: DataFrame) -> DataFrame:
    mid, lo, hi = _num("forecast"), _num("lower_bound"), _num("upper_bound")
    row = f.agg(F.count_if(mid.isNull() | lo.isNull() | hi.isNull()).alias("a"), F.count_if((lo > mid) | (mid > hi)).alias("b"))
    return _tidy(row, [("non_numeric_bounds", c("a"), WARN), ("invalid_bounds", c("b"), WARN)])


def dq_signals(s: DataFrame) -> DataFrame:
    known = F.coalesce(c("direction").isin("Bullish", "Bearish", "Neutral"), F.lit(False))
    row = s.agg(F.count_if(~known).alias("a"), F.count_if(_num("score").isNull()).alias("b"))
    return _tidy(row, [("unknown_direction", c("a"), WARN), ("non_numeric_score", c("b"), WARN)])


def dq_anomalies(a: DataFrame) -> DataFrame:
    z, cluster = F.abs(_num("z_score")), c("anomaly_type") == "cluster_spike"
    known = F.coalesce(c("severity").isin("Low", "Moderate", "High", "Critical"), F.lit(False))
    row = a.agg(F.count_if(~known).alias("a"), F.count_if(z.isNull()).alias("b"), F.count_if(~cluster & (z > 10)).alias("c"),
                F.count_if(cluster & (z > 1)).alias("d"))
    return _tidy(row, [("unknown_severity", c("a"), WARN), ("non_numeric_z", c("b"), WARN), ("extreme_z", c("c"), WARN),
                       ("cluster_share_above_one", c("d"), WARN)])


def dq_depth(df: DataFrame) -> DataFrame:
    """Distinct days against the minimum history and the two rolling windows."""
    row = df.groupBy("date").agg(F.count(F.lit(1)).alias("n")).agg(F.count("date").alias("d"))

    def short_of(n):
        return F.greatest(n - c("d"), F.lit(0))

    long = F.when(c("d") < cfg.SHORT_WINDOW, F.lit(0)).otherwise(short_of(cfg.LONG_WINDOW))
    return _tidy(row, [("min_history_days", short_of(cfg.MIN_HISTORY_DAYS), WARN),
                       ("short_window_rows", short_of(cfg.SHORT_WINDOW), WARN), ("long_window_rows", long, WARN)])


def null_density(df: DataFrame, columns: Sequence[str] | None = None, limit: float = cfg.MAX_NULL_RATE) -> DataFrame:
    """(column, null_rate, severity) of every numeric column, in one aggregate."""
    cols = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    row = df.agg(*[F.avg(F.when(c(x).isNull(), F.lit(1.0)).otherwise(F.lit(0.0))).alias(x) for x in cols])
    rate = c("null_rate")
    return row.unpivot([], cols, "column", "null_rate").select(
        "column", rnd(rate, 6).alias("null_rate"), F.when(rate > limit, WARN).otherwise(F.lit("ok")).alias("severity"))


def dq_bars(raw: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Per symbol: missing or non-positive closes, inverted bars, repeated days, zero volume, wide gaps, short history.

    Counts are partial aggregates.  Gaps need neighbours, so they run over one row per (symbol, date).
    """
    close, hi, lo, vol = _num("close"), _num("high"), _num("low"), _num("volume")
    per_day = raw.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"), F.count(close).alias("closes"), F.count_if(close <= 0).alias("nonpos"),
        F.count_if(hi < lo).alias("inv"), F.count_if(F.coalesce(vol, F.lit(0.0)) == 0).alias("zero"),
        F.min_by(F.struct(_num("open").alias("o"), close.alias("c")), F.struct(*order) if order else c("date")).alias("r"))
    prev = F.lag("r.c").over(W.ordered(["symbol"]))
    gap = F.abs(div(c("r.o") - prev, prev)) > cfg.OVERNIGHT_GAP
    g = per_day.withColumn("_gap", gap).groupBy("symbol").agg(
        *[F.sum(k).alias(k) for k in ("n", "closes", "nonpos", "inv", "zero")], F.sum(c("n") - 1).alias("dup"),
        F.count_if("_gap").alias("gaps"))
    dead = c("closes") == 0
    rules = [("close_all_null", dead.cast("int"), ERR), ("close_not_positive", c("nonpos"), WARN), ("high_below_low", c("inv"), WARN),
             ("duplicate_dates", c("dup"), WARN), ("zero_volume", c("zero"), WARN), ("overnight_gap", c("gaps"), WARN),
             ("rows_missing", F.greatest(cfg.MIN_BARS - c("n"), F.lit(0)), WARN)]
    return _tidy(g, rules, ["symbol"])


KEY_INDICATORS = ("rsi_14", "macd", "bb_upper", "atr_14", "drawdown_pct")


def dq_features(features: DataFrame) -> DataFrame:
    """Per symbol: null density of the key indicators; a column that is not there at all is missing in every row."""
    absent = {x: F.lit(None).cast("double") for x in KEY_INDICATORS if x not in features.columns}
    g = features.withColumns(absent).groupBy("symbol").agg(*[
        F.avg(F.when(c(x).isNull(), F.lit(1.0)).otherwise(F.lit(0.0))).alias(x) for x in KEY_INDICATORS])
    return g.unpivot(["symbol"], list(KEY_INDICATORS), "column", "null_rate").select(
        "symbol", "column", rnd(c("null_rate"), 6).alias("null_rate"),
        F.when(c("null_rate") > cfg.MAX_NULL_RATE, WARN).otherwise(F.lit("ok")).alias("severity"))
