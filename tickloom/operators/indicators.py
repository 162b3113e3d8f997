"""Technical indicators for every symbol at once.

One hash partitioning on ``symbol`` serves all trailing windows (they share a
sort) and the recursive columns, which are window sums too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tickloom import config as cfg
from tickloom.functions import ladders, windows as W
from tickloom.functions.numeric import div, rnd
from tickloom.operators import ewm as E

SYM = ["symbol"]
U = ["universe"]


def sma_ema(df: DataFrame, value: str, rows: int, by=tuple(SYM)) -> DataFrame:
    by = list(by)
    return E.with_ewm(df, by, [E.span(f"ema_{rows}", value, rows)]).withColumn(
        f"sma_{rows}", rnd(W.mean(F.col(value), W.trailing(by, rows)), 4))


def market_indicators(hist: DataFrame) -> DataFrame:
    """Eleven trailing indicators of the per-day market table."""
    c, s, l = F.col, cfg.SHORT_WINDOW, cfg.LONG_WINDOW
    w7, w30, wo = W.trailing(U, s), W.trailing(U, l), W.ordered(U)
    base = hist.select("universe", "date", "avg_pct", "volatility", "breadth_pct")
    base = E.with_ewm(base, U, [E.span("ema_avg_7d", "avg_pct", s), E.span("ema_avg_30d", "avg_pct", l),
                                E.span("breadth_ema_7d", "breadth_pct", s)])
    out = base.select(
        "*", rnd(W.mean(c("avg_pct"), w7), 4).alias("sma_avg_7d"), rnd(W.mean(c("avg_pct"), w30), 4).alias("sma_avg_30d"),
        rnd(W.momentum(c("avg_pct"), s, wo), 4).alias("mom_avg_7d"),
        rnd(W.zscore(c("volatility"), w7), 4).alias("vol_zscore_7d"),
        rnd(W.mean(c("breadth_pct"), w7), 4).alias("breadth_sma_7d"),
        rnd(W.momentum(c("breadth_pct"), s, wo), 4).alias("breadth_mom_7d"),
        rnd(W.zscore(c("avg_pct"), w7), 4).alias("signal_strength"))
    return out.withColumn("trend_7_30", ladders.trend(c("sma_avg_7d"), c("sma_avg_30d")))


def market_average(prices: DataFrame) -> DataFrame:
    """Mean change per (universe, date): a partial aggregate, joined back instead of a window over a whole day."""
    return prices.groupBy("universe", "date").agg(F.avg("pct_change").alias("mkt_avg"))


def symbol_indicators(prices: DataFrame) -> DataFrame:
    c, s = F.col, cfg.SHORT_WINDOW
    w7, w30 = W.trailing(SYM, s), W.trailing(SYM, cfg.LONG_WINDOW)
    joined = prices.join(market_average(prices), ["universe", "date"], "left")
    out = joined.select(
        *prices.columns, rnd(W.mean(c("price"), w7), 4).alias("sma_price_7d"),
        rnd(W.mean(c("price"), w30), 4).alias("sma_price_30d"),
        rnd(W.momentum(c("price"), s, W.ordered(SYM)), 4).alias("price_momentum"),
        rnd(W.std(c("pct_change"), w7), 4).alias("pct_volatility"),
        rnd(W.zscore(c("pct_change"), w7), 4).alias("signal_strength"),
        rnd(c("pct_change") - c("mkt_avg"), 4).alias("rel_momentum"))
    out = out.withColumn("trend_direction", ladders.trend(c("sma_price_7d"), c("sma_price_30d")))
    return E.with_ewm(out, SYM, [E.span("ema_price_7d", "price", s)])


def universe_signals(prices: DataFrame) -> DataFrame:
    """Each symbol's indicators on the universe's latest day, strongest first."""
    last = prices.groupBy("universe").agg(F.max("date").alias("date"))
    cols = ["universe", "symbol", "price", "pct_change", "trend_direction", "signal_strength", "rel_momentum",
            "pct_volatility"]
    return (symbol_indicators(prices).join(last, ["universe", "date"], "left_semi").select(*cols)
            .orderBy(F.col("signal_strength").desc_nulls_last(), "symbol"))


def with_multiplier(df: DataFrame) -> DataFrame:
    """Add ``vol_regime_mult``: where the last month's return deviation ranks among the symbol's quarter deviations.

    Window expressions only, on the partitioning and sort the other indicators use, so the bars are read once.
    """
    wo, q, c, all_ = W.ordered(SYM), cfg.ADAPTIVE_LOOKBACK, F.col, W.whole(SYM)
    w63 = W.trailing(SYM, q)
    prev = F.lag("close").over(wo)
    d = df.withColumn("_r", div(c("close") - prev, prev))
    # The first row has no return, so q returns need q + 1 rows; a missing return inside would shift the frame by one.
    d = d.select("*", F.count("_r").over(all_).alias("_n"), F.count("_r").over(W.up_to(SYM)).alias("_i"),
                 F.when(F.count("_r").over(w63) >= q, F.stddev_samp("_r").over(w63)).alias("_hist"))
    d = d.select("*", F.stddev_samp(F.when(c("_i") > c("_n") - cfg.ADAPTIVE_RECENT, c("_r"))).over(all_).alias("_recent"))
    d = d.select("*", F.count_if(c("_hist") < c("_recent")).over(all_).alias("_below"), F.count("_hist").over(all_).alias("_h"))
    rank = div(c("_below"), c("_h"))
    mult = (F.when(c("_n") < q, F.lit(1.0)).when(rank >= cfg.ADAPTIVE_HIGH, F.lit(cfg.ADAPTIVE_FAST_MULT))
            .when(rank <= cfg.ADAPTIVE_LOW, F.lit(cfg.ADAPTIVE_SLOW_MULT)).otherwise(F.lit(1.0)))
    return d.select(*df.columns, mult.alias("vol_regime_mult"))


def regime_windows(bars: DataFrame) -> DataFrame:
    """Per symbol: the window multiplier of its volatility regime and the window sizes that follow from it."""
    m = with_multiplier(bars.select("symbol", "date", "close")).groupBy("symbol").agg(F.max("vol_regime_mult").alias("mult"))
    names = ("rsi", "bb", "atr", "macd_fast", "macd_slow", "macd_signal")
    sizes = []
    for i, name in enumerate(names):
        pick = F.lit(cfg.REGIME_WINDOWS[1.00][i])
        for k in (0.70, 1.35):
            pick = F.when(F.col("mult") == k, F.lit(cfg.REGIME_WINDOWS[k][i])).otherwise(pick)
        sizes.append(pick.alias(name))
    return m.select("symbol", "mult", *sizes)


def moves(df: DataFrame) -> DataFrame:
    """Daily gain and loss of the close, true range and directional movement, as inputs of the recursive indicators."""
    wo, c = W.ordered(SYM), F.col
    d = df.select("*", F.lag("close").over(wo).alias("_pc"), (c("high") - F.lag("high").over(wo)).alias("_up"),
                  (F.lag("low").over(wo) - c("low")).alias("_dn"))
    step, zero = c("close") - c("_pc"), F.lit(0.0)
    return d.select(
        *df.columns, F.when(step > 0, step).when(step.isNotNull(), zero).alias("_gain"),
        F.when(step < 0, -step).when(step.isNotNull(), zero).alias("_loss"),
        F.greatest(c("high") - c("low"), F.abs(c("high") - c("_pc")), F.abs(c("low") - c("_pc"))).alias("_tr"),
        F.when((c("_up") > c("_dn")) & (c("_up") > 0), c("_up")).otherwise(zero).alias("_pdm"),
        F.when((c("_dn") > c("_up")) & (c("_dn") > 0), c("_dn")).otherwise(zero).alias("_mdm"))


def _rsi_value(gain: str, loss: str):
    return rnd(100 - div(F.lit(100.0), 1 + div(F.col(gain), F.col(loss))), 4)


def _di(dm: str, rng: str):
    return rnd(div(100 * F.col(dm), F.col(rng)), 4)


def _dx():
    plus, minus = F.col("plus_di"), F.col("minus_di")
    return rnd(div(100 * F.abs(plus - minus), plus + minus), 4)


def _stoch(df: DataFrame, r: str, rows: int) -> DataFrame:
    """%K and %D of the RSI column ``r``."""
    c, w, w3 = F.col, W.trailing(SYM, rows), W.trailing(SYM, 3)
    d = df.select("*", F.min(r).over(w).alias("_lo"), F.max(r).over(w).alias("_hi"))
    d = d.withColumn("_raw", rnd(div(c(r) - c("_lo"), rnd(c("_hi") - c("_lo"), 4)), 4))
    d = d.withColumn("stochrsi_k", rnd(W.mean(c("_raw"), w3), 4))
    return d.withColumn("stochrsi_d", rnd(W.mean(c("stochrsi_k"), w3), 4)).drop("_lo", "_hi", "_raw")


def rsi(bars: DataFrame, rows: int = cfg.RSI_WINDOW) -> DataFrame:
    d = E.with_ewm(moves(bars), SYM, [E.wilder("_g", "_gain", rows), E.wilder("_l", "_loss", rows)])
    return d.select(*bars.columns, _rsi_value("_g", "_l").alias("rsi"))


def macd(bars: DataFrame, fast: int = cfg.MACD_FAST, slow: int = cfg.MACD_SLOW, signal: int = cfg.MACD_SIGNAL) -> DataFrame:
    """Both averages are rounded before the line, and the line before its signal."""
    d = E.with_ewm(bars, SYM, [E.span("_f", "close", fast), E.span("_s", "close", slow)])
    d = d.withColumn("macd", rnd(F.col("_f") - F.col("_s"), 4))
    d = E.with_ewm(d, SYM, [E.span("macd_signal", "macd", signal)])
    return d.select(*bars.columns, "macd", "macd_signal", rnd(F.col("macd") - F.col("macd_signal"), 4).alias("macd_hist"))


def atr(bars: DataFrame, rows: int = cfg.ATR_WINDOW) -> DataFrame:
    return E.with_ewm(moves(bars), SYM, [E.wilder("atr", "_tr", rows, 4)]).select(*bars.columns, "atr")


def adx(bars: DataFrame, rows: int = cfg.ATR_WINDOW) -> DataFrame:
    d = E.with_ewm(moves(bars), SYM, [E.wilder("_t", "_tr", rows), E.wilder("_p", "_pdm", rows), E.wilder("_m", "_mdm", rows)])
    d = d.select(*bars.columns, _di("_p", "_t").alias("plus_di"), _di("_m", "_t").alias("minus_di"))
    d = E.with_ewm(d.withColumn("_dx", _dx()), SYM, [E.wilder("adx_14", "_dx", rows, 4)])
    return d.select(*bars.columns, "adx_14", "plus_di", "minus_di")


def stoch_rsi(bars: DataFrame, rsi_rows: int = cfg.RSI_WINDOW, rows: int = cfg.RSI_WINDOW) -> DataFrame:
    return _stoch(rsi(bars, rsi_rows), "rsi", rows).drop("rsi")


def _bands(df: DataFrame, middle, sd, sigma: float = cfg.BB_SIGMA) -> DataFrame:
    """Bands from a rounded middle and an unrounded deviation; every level is rounded before the next uses it."""
    c = F.col
    out = df.withColumn("bb_middle", rnd(middle, 4)).withColumn("_sd", sd)
    out = (out.withColumn("bb_upper", rnd(c("bb_middle") + sigma * c("_sd"), 4))
           .withColumn("bb_lower", rnd(c("bb_middle") - sigma * c("_sd"), 4)))
    width = rnd(c("bb_upper") - c("bb_lower"), 4)
    return (out.withColumn("bb_width", rnd(div(width, c("bb_middle")), 4))
            .withColumn("bb_pct_b", rnd(div(c("close") - c("bb_lower"), width), 4)).drop("_sd"))


def bollinger(bars: DataFrame, rows: int = cfg.BB_WINDOW, sigma: float = cfg.BB_SIGMA) -> DataFrame:
    w = W.trailing(SYM, rows)
    return _bands(bars, W.mean(F.col("close"), w), W.std(F.col("close"), w), sigma)


def drawdown(bars: DataFrame, rows: int = cfg.DRAWDOWN_WINDOW) -> DataFrame:
    peak = F.max("close").over(W.trailing(SYM, rows))
    return bars.withColumn("_peak", peak).select(
        *bars.columns, rnd(div(F.col("close") - F.col("_peak"), F.col("_peak")), 4).alias("drawdown_pct"),
        rnd(F.col("_peak"), 4).alias("rolling_max"))


def indicator_suite(bars: DataFrame, complete: bool = False) -> DataFrame:
    """The full indicator frame of every symbol; extra columns of ``bars`` pass through.

    One shuffle by symbol.  ``complete`` states that no open/high/low/close is missing, as in bars built from ticks.
    """
    return _recursive(windowed(with_multiplier(bars)), complete)


def windowed(base: DataFrame) -> DataFrame:
    """The columns of the suite that are trailing windows; ``base`` has ``vol_regime_mult``."""
    c, wo = F.col, W.ordered(SYM)
    close = c("close")
    if "returns_pct" not in base.columns:
        base = base.withColumn("returns_pct", rnd(div(close - F.lag(close).over(wo), F.lag(close).over(wo)) * 100, 4))

    def adaptive(fn):
        """Three static frames, one per regime."""
        pick = fn(close, W.trailing(SYM, cfg.REGIME_WINDOWS[1.00][1]))
        for m in (0.70, 1.35):
            pick = F.when(c("vol_regime_mult") == m, fn(close, W.trailing(SYM, cfg.REGIME_WINDOWS[m][1]))).otherwise(pick)
        return pick

    peak = F.max(close).over(W.trailing(SYM, cfg.DRAWDOWN_WINDOW))
    out = base.select(
        *base.columns, rnd(W.mean(close, W.trailing(SYM, cfg.SMA_FAST)), 4).alias("sma_20"),
        rnd(W.mean(close, W.trailing(SYM, cfg.SMA_SLOW)), 4).alias("sma_50"),
        adaptive(W.mean).alias("_mid"), adaptive(W.std).alias("_dev"), peak.alias("_peak"),
        rnd(W.std(c("returns_pct"), W.trailing(SYM, 21)), 4).alias("volatility_21"),
        rnd(W.momentum(close, cfg.MOMENTUM_WINDOW, wo), 4).alias("momentum_10"),
        rnd(W.zscore(c("returns_pct"), W.trailing(SYM, cfg.SHORT_WINDOW)), 4).alias("signal_strength"),
        rnd(W.mean(c("volume"), W.trailing(SYM, 20)), 4).alias("volume_sma_20"))
    out = (out.withColumn("drawdown_pct", rnd(div(close - c("_peak"), c("_peak")), 4))
           .withColumn("rolling_max", rnd(c("_peak"), 4)))
    return _bands(out, c("_mid"), c("_dev")).drop("_mid", "_dev", "_peak")


def levels() -> tuple[list[E.Ewm], list[E.Ewm]]:
    """The suite's averages of prices and moves, and the averages of those; sizes follow ``vol_regime_mult``."""
    mult = F.col("vol_regime_mult")
    size = {name: {m: v[i] for m, v in cfg.REGIME_WINDOWS.items()}
            for i, name in enumerate(("rsi", "bb", "atr", "fast", "slow", "signal"))}
    n, w = cfg.ATR_WINDOW, cfg.RSI_WINDOW
    level1 = [
        E.by_regime("ema_12", "close", mult, size["fast"], True, 4), E.by_regime("ema_26", "close", mult, size["slow"], True, 4),
        E.by_regime("_g", "_gain", mult, size["rsi"], False, None, 1), E.by_regime("_l", "_loss", mult, size["rsi"], False, None, 1),
        E.by_regime("atr_14", "_tr", mult, size["atr"], False, 4), E.wilder("_g14", "_gain", w, skip=1),
        E.wilder("_l14", "_loss", w, skip=1), E.wilder("_t", "_tr", n), E.wilder("_p", "_pdm", n), E.wilder("_m", "_mdm", n)]
    return level1, [E.by_regime("macd_signal", "macd", mult, size["signal"], True, 4), E.wilder("adx_14", "_dx", n, 4)]


def from_first_level(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns that follow from the first level's averages: RSI (also at its plain size), MACD line, directional indices."""
    c = F.col
    return df.select(
        *keep, "ema_12", "ema_26", "atr_14", _rsi_value("_g", "_l").alias("rsi_14"), _rsi_value("_g14", "_l14").alias("_r14"),
        rnd(c("ema_12") - c("ema_26"), 4).alias("macd"), _di("_p", "_t").alias("plus_di"), _di("_m", "_t").alias("minus_di")).withColumn(
            "_dx", _dx())


def from_second_level(df: DataFrame) -> DataFrame:
    return _stoch(df.withColumn("macd_hist", rnd(F.col("macd") - F.col("macd_signal"), 4)), "_r14", cfg.RSI_WINDOW).drop("_dx", "_r14")


def _recursive(df: DataFrame, complete: bool) -> DataFrame:
    """The recursive columns of the suite in two passes."""
    level1, level2 = levels()
    numbered = E.number_rows(moves(df), SYM, "date", E.block_rows(level1 + level2))
    first = E.with_ewm(numbered, SYM, level1, nulls=not complete)
    second = E.with_ewm(from_first_level(first, [*df.columns, "_rn", "_blk", "_i"]), SYM, level2)
    return from_second_level(second).drop("_rn", "_blk", "_i")


def cum_return(bars: DataFrame, min_rows: int = 20) -> DataFrame:
    """Return since the symbol's first bar, for symbols with enough bars."""
    have = bars.where(F.col("close").isNotNull())
    first = F.first("close").over(W.ordered(SYM).rowsBetween(Window.unboundedPreceding, 0))
    n = F.count(F.lit(1)).over(W.whole(SYM))
    return (have.select("symbol", "date", "close", first.alias("_f"), n.alias("_n")).where(F.col("_n") >= min_rows)
            .select("symbol", "date", rnd((div(F.col("close"), F.col("_f")) - 1) * 100, 2).alias("cum_ret")))


def backfill_day(bars: DataFrame, names: DataFrame, day) -> DataFrame:
    """Price rows of one day against each symbol's previous available close; unusable rows are left out."""
    prev = F.lag("close").over(W.ordered(SYM))
    rows = bars.where(F.col("date") <= day).select("symbol", "date", "close", prev.alias("_p")).where(
        (F.col("date") == day) & F.col("close").isNotNull() & F.col("_p").isNotNull() & (F.col("_p") != 0))
    move = F.col("close") - F.col("_p")
    return rows.join(names, "symbol", "left").select(
        "date", "symbol", F.coalesce("company_name", F.lit("")).alias("company_name"),
        rnd(F.col("close"), 4).alias("price"), rnd(move, 4).alias("change"),
        rnd(div(rnd(move, 4), F.col("_p")) * 100, 2).alias("pct_change"))


def recent_context(df: DataFrame, by: list[str], rows: int = 14) -> DataFrame:
    """The last ``rows`` days of each series."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("date").desc()))
    return df.withColumn("_r", rn).where(F.col("_r") <= rows).drop("_r")


def run_indicators(raw: DataFrame, order: list[str], have: DataFrame | None = None) -> DataFrame:
    """preprocess -> indicators for symbols whose stored features (``have``) are behind their bars."""
    from tickloom.operators.preprocess import preprocess_bars
    if have is not None:
        newest = raw.groupBy("symbol").agg(F.max("date").alias("_bar"))
        stored = have.groupBy("symbol").agg(F.max("date").alias("_feat"))
        stale = newest.join(stored, "symbol", "left").where(F.col("_feat").isNull() | (F.col("_feat") < F.col("_bar")))
        raw = raw.join(stale, "symbol", "left_semi")
    return indicator_suite(preprocess_bars(raw, order))
