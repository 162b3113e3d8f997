"""Cleaning and preparation of bars, and generic key operations on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tickloom import config as cfg
from tickloom.functions import windows as W
from tickloom.functions.numeric import div, rnd
from tickloom.operators.orderstats import quantiles

NUMERIC = ("open", "high", "low", "close", "volume")
SYM = ["symbol"]


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key, the first (or last) in ``order``.

    ``min_by``/``max_by`` merge map-side, so copies of a hot key never meet in one sort as they would under
    ``row_number``.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def clean_bars(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """Cast, drop rows without a close, clip negatives, swap inverted high/low, keep the last row per (symbol, date)."""
    num = {c: F.col(c).try_cast("double") for c in NUMERIC}
    typed = raw.select("symbol", F.col("date").try_cast("date").alias("date"), *order,
                       *[F.when(~F.isnan(v), v).alias(c) for c, v in num.items()])
    kept = typed.where(F.col("close").isNotNull())
    for c in ("open", "high", "low", "volume"):
        kept = kept.withColumn(c, F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0))))
    hi, lo = F.col("high"), F.col("low")
    swap = hi < lo
    kept = kept.select("symbol", "date", *order, "open", F.when(swap, lo).otherwise(hi).alias("high"),
                       F.when(swap, hi).otherwise(lo).alias("low"), "close", "volume")
    return keep_one(kept, ["symbol", "date"], order, last=True).drop(*order)


def bar_returns(bars: DataFrame) -> DataFrame:
    prev = F.lag("close").over(W.ordered(SYM))
    p = F.col("_prev")
    ratio = div(F.col("close"), p)
    return bars.withColumn("_prev", prev).select(
        *bars.columns, rnd(div(F.col("close") - p, p) * 100, 4).alias("returns_pct"),
        rnd(F.when(ratio > 0, F.log(ratio)), 6).alias("log_returns"),
        rnd(div(F.col("open") - p, p) * 100, 4).alias("gap_pct"),
        rnd(div(F.col("high") - F.col("low"), p) * 100, 4).alias("intraday_range_pct"))


def outlier_flag(df: DataFrame, column: str = "returns_pct", rows: int = cfg.OUTLIER_WINDOW,
                 sigma: float = cfg.OUTLIER_SIGMA, min_rows: int = cfg.OUTLIER_MIN_ROWS) -> DataFrame:
    c, w = F.col(column), W.trailing(SYM, rows)
    z = rnd(div(c - W.mean(c, w), W.std(c, w)), 9)
    flag = F.coalesce((F.abs(z) > sigma) & (F.count(c).over(w) >= min_rows), F.lit(False))
    return df.withColumn(f"{column}_outlier", flag)


def split_detect(bars: DataFrame) -> DataFrame:
    ratio = div(F.col("close"), F.lag("close").over(W.ordered(SYM)))
    return (bars.select("symbol", "date", ratio.alias("ratio"))
            .where((F.col("ratio") < cfg.SPLIT_LOW) | (F.col("ratio") > cfg.SPLIT_HIGH))
            .select("symbol", "date", rnd(F.col("ratio"), 6).alias("ratio")))


def business_grid(bars: DataFrame) -> DataFrame:
    """Every Monday-to-Friday between a symbol's first and last bar."""
    span = bars.groupBy("symbol").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    return (span.select("symbol", F.explode(F.sequence("_a", "_b")).alias("date")).where(F.weekday("date") < 5))


def gap_fill(bars: DataFrame, max_gap: int = cfg.GAP_FILL_MAX) -> DataFrame:
    """Reindex to business days; carry the last bar over gaps of up to ``max_gap`` days with volume 0."""
    full = business_grid(bars).join(bars, ["symbol", "date"], "left")
    missing = F.col("close").isNull()
    up = W.up_to(SYM)
    full = full.withColumn("_gap", F.sum(F.when(missing, 0).otherwise(1)).over(up))
    size = F.sum(F.when(missing, 1).otherwise(0)).over(Window.partitionBy("symbol", "_gap"))
    full = full.withColumn("_fill", missing & (size <= max_gap))
    cols = [F.when(F.col("_fill"), F.last(c, ignorenulls=True).over(up)).otherwise(F.col(c)).alias(c)
            for c in ("open", "high", "low", "close")]
    return full.select("symbol", "date", *cols,
                       F.when(F.col("_fill"), F.lit(0.0)).otherwise(F.col("volume")).alias("volume"),
                       F.col("_fill").alias("filled"))


def normalise(df: DataFrame, column: str, method: str = "minmax", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """zscore / minmax / robust per group from grouped statistics joined back; no group is gathered in one task."""
    by, c = list(by), F.col(column)
    if method == "robust":
        stats = quantiles(df, by, column, [0.25, 0.5, 0.75])
        spread = F.col("q2") - F.col("q0")
        value = F.when(spread == 0, c - F.col("q1")).otherwise(div(c - F.col("q1"), spread))
    elif method == "zscore":
        stats = df.groupBy(*by).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
        value = F.when(F.col("_s") == 0, c - F.col("_m")).otherwise(div(c - F.col("_m"), F.col("_s")))
    else:
        stats = df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
        value = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.0)).otherwise(
            div(c - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return df.join(stats, by, "left").select(*df.columns, rnd(value, 6).alias(f"{column}_{method}"))


def sound_symbols(raw: DataFrame) -> DataFrame:
    """Symbols that pass the hard checks (a close that is not entirely missing)."""
    close = F.col("close").try_cast("double")
    return raw.groupBy("symbol").agg(F.count(F.when(~F.isnan(close), close)).alias("_n")).where("_n > 0").select("symbol")


def preprocess_bars(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """validate -> clean -> returns -> outlier flag for all symbols; failing symbols yield no rows."""
    sound = raw.join(sound_symbols(raw), "symbol", "left_semi")
    return outlier_flag(bar_returns(clean_bars(sound, order)))


def upsert_bars(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows plus fresh ones; a fresh row replaces the stored row of its (symbol, date)."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return keep_one(both, ["symbol", "date"], ["_new"], last=True).drop("_new")


def incremental_tail(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` past each symbol's stored high-water mark, appended to ``stored``."""
    mark = stored.groupBy("symbol").agg(F.max("date").alias("_hwm"))
    tail = (incoming.join(mark, "symbol", "left")
            .where(F.col("_hwm").isNull() | (F.col("date") > F.col("_hwm"))).drop("_hwm"))
    return stored.unionByName(tail.select(*stored.columns))
