"""Short-horizon projections of many series at once: input is long (keys, date, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom import config as cfg
from tickloom.functions.numeric import div, rnd
from tickloom.operators.ewm import Ewm, with_ewm

c = F.col


def business_days(after: Column, n: int) -> Column:
    """The ``n`` weekdays following ``after``."""
    days = F.sequence(F.date_add(after, 1), F.date_add(after, 2 * n + 5))
    return F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, n)


def _steps(df: DataFrame, keys: Sequence[str], horizon: int, point: Column, margin: Column, method: str) -> DataFrame:
    """One row per forward business day; ``point`` and ``margin`` may use ``step`` (1-based)."""
    out = df.withColumn("_d", business_days(c("_last"), horizon)).select("*", F.posexplode("_d").alias("_p", "_date"))
    out = out.withColumn("step", (c("_p") + 1).cast("double"))
    return out.select(*keys, c("_date").alias("date"), rnd(point, 4).alias("forecast"),
                      rnd(point - margin, 4).alias("lower_bound"), rnd(point + margin, 4).alias("upper_bound"),
                      F.lit(method).alias("method"))


def _recent(df: DataFrame, keys: Sequence[str], value: str, rows: int) -> DataFrame:
    """Last ``rows`` non-null observations per key, numbered back from 1; limited inside each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(c("date").desc())
    return (df.where(c(value).isNotNull()).select(*keys, "date", c(value).alias("_y"))
            .withColumn("_rn", F.row_number().over(w)).where(c("_rn") <= rows))


def forecast_sma(df: DataFrame, keys: Sequence[str], value: str, horizon: int = cfg.HORIZON,
                 window: int = cfg.SHORT_WINDOW) -> DataFrame:
    g = _recent(df, keys, value, window).groupBy(*keys).agg(
        F.max("date").alias("_last"), F.avg("_y").alias("_mean"), F.coalesce(F.stddev_samp("_y"), F.lit(0.0)).alias("_sd"))
    return _steps(g, keys, horizon, c("_mean"), c("_sd") * F.sqrt("step"), "sma")


def forecast_ema(df: DataFrame, keys: Sequence[str], value: str, horizon: int = cfg.HORIZON,
                 window: int = cfg.SHORT_WINDOW) -> DataFrame:
    clean = df.where(c(value).isNotNull()).select(*keys, "date", value)
    ema = with_ewm(clean, keys, [Ewm("_ema", value, 2.0 / (window + 1), 1, None)]).groupBy(*keys).agg(
        F.max_by("_ema", "date").alias("_point"))
    spread = _recent(df, keys, value, window).groupBy(*keys).agg(
        F.max("date").alias("_last"), F.coalesce(F.stddev_samp("_y"), F.lit(0.0)).alias("_sd"))
    return _steps(ema.join(spread, list(keys)), keys, horizon, c("_point"), c("_sd") * F.sqrt("step"), "ema")


def forecast_linear(df: DataFrame, keys: Sequence[str], value: str, horizon: int = cfg.HORIZON,
                    fit: int = cfg.FIT_WINDOW) -> DataFrame:
    """Least-squares line through the last ``fit`` observations; under three of them, their mean."""
    y, x = c("_y"), -c("_rn").cast("double")
    g = _recent(df, keys, value, fit).withColumn("_x", x).groupBy(*keys).agg(
        F.max("date").alias("_last"), F.count("_y").cast("double").alias("_n"), F.avg("_y").alias("_mean"),
        F.coalesce(F.stddev_samp("_y"), F.lit(0.0)).alias("_sd"), F.regr_slope("_y", "_x").alias("_b"),
        F.regr_intercept("_y", "_x").alias("_a"), F.regr_syy("_y", "_x").alias("_syy"), F.regr_sxx("_y", "_x").alias("_sxx"))
    sse = F.greatest(c("_syy") - c("_b") * c("_b") * c("_sxx"), F.lit(0.0))
    se = F.greatest(F.sqrt(sse / c("_n")), F.lit(1e-6))
    short = c("_n") < 3
    # The newest observation sits at x = -1, so step h is at x = h - 1.
    point = F.when(short, c("_mean")).otherwise(c("_a") + c("_b") * (c("step") - 1))
    margin = F.when(short, c("_sd") * F.sqrt("step")).otherwise(cfg.CONFIDENCE_Z * se * F.sqrt(div(c("step"), c("_n"))))
    return _steps(g, keys, horizon, point, margin, "linear")


METHODS = {"sma": forecast_sma, "linear": forecast_linear}


def forecast_series(df: DataFrame, keys: Sequence[str], value: str, method: str = "linear",
                    horizon: int = cfg.HORIZON) -> DataFrame:
    return METHODS.get(method, forecast_ema)(df, keys, value, horizon)


def forecast_metrics(hist: DataFrame, metrics: Sequence[str] = ("avg_pct", "volatility", "breadth_pct"),
                     method: str = "linear", horizon: int = cfg.HORIZON) -> DataFrame:
    """All market metrics of all universes in one grouped job; a metric the table lacks yields no rows."""
    have = [m for m in metrics if m in hist.columns]
    long = hist.unpivot(["universe", "date"], have, "metric", "value")
    return forecast_series(long, ["universe", "metric"], "value", method, horizon)


def forecast_sentiment(daily: DataFrame, method: str = "linear", horizon: int = cfg.HORIZON) -> DataFrame:
    """Projection of the raw daily score."""
    series = daily.select(F.lit("sentiment").alias("metric"), "date", "avg_score")
    return forecast_series(series, ["metric"], "avg_score", method, horizon)
