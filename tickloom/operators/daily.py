"""Market-level metrics: one row per (universe, date), and the intelligence built on that small table.

The cross-section is one partial aggregate.  Windows after it run over days,
partitioned by ``universe``, never over source rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tickloom import config as cfg
from tickloom.functions import ladders, windows as W
from tickloom.functions.numeric import adjusted_kurtosis, adjusted_skew, div, rnd
from tickloom.operators.ewm import span, with_ewm

U = ["universe"]
KEY = ["universe", "date"]


def breadth_share():
    gain, loss, flat = F.col("n_gainers"), F.col("n_losers"), F.col("n_flat")
    return rnd(div(gain, gain + loss + flat) * 100, 2)


def cross_section(df: DataFrame) -> DataFrame:
    """Counts, moments and extremes of ``pct_change`` per (universe, date); ties go to the first symbol.

    The first aggregate has only fixed-width buffers, so it runs as a hash aggregate without sorting the rows.  The
    names of the extremes come from a second pass that keeps just the rows at a day's highest or lowest change.
    """
    pct, chg, c = F.col("pct_change"), F.col("change"), F.col
    g = df.groupBy("universe", "date").agg(
        F.count_if(chg > 0).alias("n_gainers"), F.count_if(chg < 0).alias("n_losers"),
        F.count_if(chg == 0).alias("n_flat"), F.avg(pct).alias("_avg"), F.stddev_samp(pct).alias("_sd"), F.var_pop(pct).alias("_var"),
        F.skewness(pct).alias("_g1"), F.kurtosis(pct).alias("_g2"), F.count(pct).alias("_n"),
        F.max(pct).alias("best_pct"), F.min(pct).alias("worst_pct"))
    ends = g.select("universe", "date", c("best_pct").alias("_hi"), c("worst_pct").alias("_lo"))
    who = (df.select("universe", "date", "symbol", "pct_change").join(ends, KEY).where((pct == c("_hi")) | (pct == c("_lo")))
           .groupBy(*KEY).agg(F.min(F.when(pct == c("_hi"), c("symbol"))).alias("best_stock"),
                              F.min(F.when(pct == c("_lo"), c("symbol"))).alias("worst_stock")))
    return g.join(who, KEY, "left")


def _published(g: DataFrame) -> DataFrame:
    """A cross-section with its figures rounded as they are published."""
    c = F.col
    return g.select(
        "universe", "date", "n_gainers", "n_losers", "n_flat", "_n", "_sd",
        rnd(c("_avg"), 6).alias("avg_pct"), rnd(c("_sd"), 6).alias("volatility"),
        rnd(adjusted_skew(c("_g1"), c("_n"), c("_sd")), 4).alias("skew_pct"),
        rnd(adjusted_kurtosis(c("_g2"), c("_n"), c("_sd")), 4).alias("kurt_pct"),
        breadth_share().alias("breadth_pct"), "best_stock", "best_pct", "worst_stock", "worst_pct")


def described(g: DataFrame) -> DataFrame:
    """The market table of a cross-section."""
    return _published(g).drop("_n", "_sd").select(
        "*", ladders.breadth_regime(F.col("breadth_pct")).alias("regime"), F.signum("avg_pct").alias("streak_sign"))


def daily_breadth(prices: DataFrame) -> DataFrame:
    return described(cross_section(prices))


def bar_daily_aggregates(bars: DataFrame, universe: str = "all", min_symbols: int = 10) -> DataFrame:
    """Daily cross-section from bar closes; days with few symbols are dropped, missing moments are 0."""
    prev = F.lag("close").over(W.ordered(["symbol"]))
    moves = bars.select("symbol", "date", "close", prev.alias("_p")).where(F.col("_p").isNotNull()).select(
        F.lit(universe).alias("universe"), "symbol", "date", (F.col("close") - F.col("_p")).alias("change"),
        (div(F.col("close") - F.col("_p"), F.col("_p")) * 100).alias("pct_change"))
    zero = F.lit(0.0)
    return (
        _published(cross_section(moves)).where(F.col("_n") >= min_symbols)
        .select("universe", "date", "n_gainers", "n_losers", "n_flat", rnd(F.col("avg_pct"), 4).alias("avg_pct"),
                rnd(F.coalesce("volatility", zero), 4).alias("volatility"),
                F.coalesce("skew_pct", zero).alias("skew_pct"), F.coalesce("kurt_pct", zero).alias("kurt_pct"),
                "breadth_pct", ladders.breadth_regime(F.col("breadth_pct")).alias("regime"),
                F.lit("").alias("best_stock"), zero.alias("best_pct"), F.lit("").alias("worst_stock"),
                zero.alias("worst_pct"), F.signum(rnd(F.col("avg_pct"), 4)).alias("streak_sign"))
    )


def rolling_intelligence(hist: DataFrame) -> DataFrame:
    """Attach the 17 rolling columns to a per-day table."""
    c = F.col
    w7, w30 = W.trailing(U, cfg.SHORT_WINDOW), W.trailing(U, cfg.LONG_WINDOW)
    w63 = W.trailing(U, cfg.REGIME_LOOKBACK)
    q = cfg.VAR_QUANTILE
    base = with_ewm(hist, U, [span("ema_avg_7d", "avg_pct", cfg.SHORT_WINDOW),
                              span("ema_avg_30d", "avg_pct", cfg.LONG_WINDOW)])
    first = base.select(
        "*", rnd(W.mean(c("avg_pct"), w7), 4).alias("rolling_avg_7d"),
        rnd(W.mean(c("avg_pct"), w30), 4).alias("rolling_avg_30d"),
        rnd(W.mean(c("volatility"), w7), 4).alias("rolling_vol_7d"),
        rnd(W.mean(c("volatility"), w30), 4).alias("rolling_vol_30d"),
        rnd(W.share_positive(c("avg_pct"), w7), 2).alias("trend_persistence_7d"),
        rnd(W.share_positive(c("breadth_pct") - 50, w7), 2).alias("breadth_trend_persistence_7d"),
        W.std(c("avg_pct"), w7).alias("_sd7"),
        rnd(W.pct_rank(c("volatility"), w30, 5), 4).alias("vol_pct_rank"),
        W.quantile(c("avg_pct"), q, w30, 10).alias("_p05"), W.quantile(c("avg_pct"), 1 - q, w30, 10).alias("_p95"),
        rnd(W.tail_mean(c("avg_pct"), q, w30, 10), 4).alias("cvar_5"),
        W.pct_rank(c("breadth_pct"), w63, cfg.REGIME_MIN_ROWS).alias("_rank"))
    return first.select(
        *hist.columns, "rolling_avg_7d", "rolling_avg_30d", "rolling_vol_7d", "rolling_vol_30d",
        c("rolling_avg_7d").alias("sma_avg_7d"), c("rolling_avg_30d").alias("sma_avg_30d"), "ema_avg_7d", "ema_avg_30d",
        "trend_persistence_7d", "breadth_trend_persistence_7d",
        rnd(div(c("avg_pct") - c("rolling_avg_7d"), c("_sd7")), 4).alias("rolling_signal_7d"),
        ladders.vol_regime(div(c("volatility"), c("rolling_vol_30d"))).alias("volatility_regime"), "vol_pct_rank",
        rnd(c("_p05"), 4).alias("var_5"), "cvar_5", rnd(div(c("_p95"), F.abs("_p05")), 4).alias("tail_ratio"),
        ladders.adaptive_regime(c("_rank")).alias("regime_adaptive"))


def _frequent(prices: DataFrame, side: str, per_day: int, top: int) -> DataFrame:
    """Symbols most often among a day's ``per_day`` strongest movers.

    ``row_number() <= k`` becomes a per-task group limit before the shuffle, so a crowded day sends k rows per task.
    """
    pct = F.col("pct_change")
    moving = prices.where(pct > 0 if side == "up" else pct < 0)
    order = pct.desc() if side == "up" else pct.asc()
    rank = F.row_number().over(Window.partitionBy("universe", "date").orderBy(order, "symbol"))
    daily = moving.select("universe", "date", "symbol", rank.alias("_r")).where(F.col("_r") <= per_day)
    days = prices.groupBy("universe").agg(F.countDistinct("date").alias("_days"))
    counts = daily.groupBy("universe", "symbol").agg(F.count(F.lit(1)).alias("appearances"))
    best = Window.partitionBy("universe").orderBy(F.col("appearances").desc(), "symbol")
    return (
        counts.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top).join(days, "universe")
        .select("universe", "symbol", "appearances", rnd(F.col("appearances") / F.col("_days") * 100, 1).alias("pct_days"))
    )


def frequent_movers(prices: DataFrame, per_day: int = cfg.TOP_MOVERS_PER_DAY, top: int = cfg.TOP_MOVERS) -> DataFrame:
    return _frequent(prices, "up", per_day, top)


def frequent_losers(prices: DataFrame, per_day: int = cfg.TOP_MOVERS_PER_DAY, top: int = cfg.TOP_MOVERS) -> DataFrame:
    return _frequent(prices, "down", per_day, top)


def covered_symbols(prices: DataFrame, share: float = cfg.MIN_APPEARANCE_SHARE) -> DataFrame:
    """Symbols present on at least ``share`` of the universe's days."""
    days = prices.groupBy("universe").agg(F.countDistinct("date").alias("_days"))
    need = F.greatest(F.lit(1), F.floor(F.col("_days") * share))
    return (prices.groupBy("universe", "symbol").agg(F.countDistinct("date").alias("n_days"))
            .join(days, "universe").where(F.col("n_days") >= need).select("universe", "symbol", "n_days"))


def cumulative_performance(prices: DataFrame, top: int = cfg.TOP_MOVERS) -> DataFrame:
    """Compounded % change since first appearance, long form, for the ``top`` best and worst covered symbols."""
    per_day = (prices.join(covered_symbols(prices), ["universe", "symbol"], "left_semi")
               .groupBy("universe", "symbol", "date").agg(F.avg("pct_change").alias("_pct")))
    growth = 1 + F.col("_pct") / 100
    w = W.up_to(["universe", "symbol"])
    # Running product: sign, zero and log-magnitude are summed apart so a -100% day stays exact.
    logs = F.sum(F.when(growth != 0, F.log(F.abs(growth)))).over(w)
    odd = F.sum(F.when(growth < 0, 1).otherwise(0)).over(w) % 2
    dead = F.max(F.when(growth == 0, 1).otherwise(0)).over(w) == 1
    product = F.when(dead, F.lit(0.0)).otherwise(F.when(odd == 1, -F.exp(logs)).otherwise(F.exp(logs)))
    cum = per_day.where(F.col("_pct").isNotNull()).select(
        "universe", "symbol", "date", rnd((product - 1) * 100, 4).alias("cum_pct"))
    final = cum.groupBy("universe", "symbol").agg(F.max_by("cum_pct", "date").alias("_final"))
    up = Window.partitionBy("universe").orderBy(F.col("_final").desc(), "symbol")
    down = Window.partitionBy("universe").orderBy("_final", F.col("symbol").desc())
    best = final.withColumn("_r", F.row_number().over(up)).where(F.col("_r") <= top)
    worst = final.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= top)
    chosen = best.unionByName(worst).select("universe", "symbol").distinct()
    return cum.join(chosen, ["universe", "symbol"], "left_semi")


def extreme_sessions(hist: DataFrame, n: int = cfg.EXTREME_SESSIONS) -> DataFrame:
    """The n weakest days, then the n strongest of the rest; a single day stands alone."""
    asc = Window.partitionBy("universe").orderBy("avg_pct", "date")
    total = F.count(F.lit(1)).over(W.whole(U))
    marked = hist.select("*", total.alias("_t"), F.row_number().over(asc).alias("_lo"))
    side = F.least(F.lit(n), F.floor(F.col("_t") / 2))
    marked = marked.withColumn("_weak", (F.col("_lo") <= side) & (F.col("_t") > 1))
    desc = Window.partitionBy("universe", "_weak").orderBy(F.col("avg_pct").desc(), "date")
    strong = ~F.col("_weak") & (F.col("_hi") <= F.greatest(side, F.lit(1)))
    return (marked.withColumn("_hi", F.row_number().over(desc)).where(F.col("_weak") | strong)
            .withColumn("direction", F.when(F.col("avg_pct") >= 0, "Bullish").otherwise("Bearish"))
            .drop("_t", "_lo", "_hi", "_weak"))


def _islands(df: DataFrame, sign) -> DataFrame:
    w = W.ordered(U)
    marked = df.withColumn("_sign", sign).where(F.col("_sign").isNotNull())
    marked = marked.withColumn("_new", W.island(F.col("_sign"), w))
    return marked.withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(
        F.col("_sign") != 0)


def streaks(hist: DataFrame) -> DataFrame:
    """Runs of days whose average change keeps one sign; flat days break a run and form none."""
    return (
        _islands(hist, F.col("streak_sign")).groupBy("universe", "_id", "_sign")
        .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"),
             F.count(F.lit(1)).alias("length"), rnd(F.avg("avg_pct"), 4).alias("avg_pct"))
        .select("universe", "start_date", "end_date", "length",
                F.when(F.col("_sign") > 0, "Bullish").otherwise("Bearish").alias("direction"), "avg_pct")
    )


def market_cycles(hist: DataFrame) -> DataFrame:
    """Runs of the 7-day average's sign, with the mean and the most extreme day of each."""
    return (
        _islands(hist, F.signum("rolling_avg_7d")).groupBy("universe", "_id", "_sign")
        .agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"),
             F.count(F.lit(1)).alias("length_days"), rnd(F.avg("avg_pct"), 4).alias("avg_return"),
             F.max("avg_pct").alias("_hi"), F.min("avg_pct").alias("_lo"))
        .select("universe", "start_date", "end_date", "length_days",
                F.when(F.col("_sign") > 0, "Bull").otherwise("Bear").alias("direction"), "avg_return",
                rnd(F.when(F.col("_sign") > 0, F.col("_hi")).otherwise(F.col("_lo")), 4).alias("peak_return"))
    )


def baseline_vol(hist: DataFrame) -> DataFrame:
    """Latest volatility against the mean of all days before it, per universe."""
    last = F.max("date").over(W.whole(U))
    return (hist.withColumn("_last", last).groupBy("universe")
            .agg(F.count(F.lit(1)).alias("n_days"), F.max(F.when(F.col("date") == F.col("_last"), F.col("volatility")))
                 .alias("latest_vol"), F.avg(F.when(F.col("date") < F.col("_last"), F.col("volatility"))).alias("_b"))
            .select("universe", "n_days", "latest_vol",
                    rnd(F.when(F.col("n_days") >= 2, F.col("_b")).otherwise(F.col("latest_vol")), 6).alias("baseline_vol"),
                    (F.col("n_days") >= 2).alias("has_history")))


def compute_all(prices: DataFrame) -> dict[str, DataFrame]:
    """Every historical view of a price table.

    Nothing is cached here: a caller that writes several views writes ``hist`` first and passes what it reads back to :func:`views_of`.
    """
    return {"freq_movers": frequent_movers(prices), "freq_losers": frequent_losers(prices), "cumulative": cumulative_performance(prices),
            **views_of(rolling_intelligence(daily_breadth(prices)))}


def views_of(hist: DataFrame) -> dict[str, DataFrame]:
    """The historical views that need the per-day table alone."""
    return {"hist": hist, "sessions": extreme_sessions(hist), "streaks": streaks(hist), "baseline": baseline_vol(hist),
            "cycles": market_cycles(hist)}


# --- time-series views of one metric ---------------------------------------------------------------------------------

def decompose(df: DataFrame, value: str, rows: int, by=tuple(U)) -> DataFrame:
    c, by = F.col(value), list(by)
    trend, trailing = W.mean(c, W.centred(by, rows)), W.mean(c, W.trailing(by, rows))
    return df.select(*by, "date", rnd(c, 4).alias("original"), rnd(trend, 4).alias("trend"),
                     rnd(c - trend, 4).alias("residual"), rnd(trailing, 4).alias("smoothed"))


def rolling_stats(df: DataFrame, value: str, rows: int, by=tuple(U)) -> DataFrame:
    c, by = F.col(value), list(by)
    w = W.trailing(by, rows)
    out = df.select(
        *by, "date", rnd(W.mean(c, w), 4).alias("mean"), rnd(W.std(c, w), 4).alias("std"),
        rnd(F.min(c).over(w), 4).alias("min"), rnd(F.max(c).over(w), 4).alias("max"),
        rnd(W.skew(c, w), 4).alias("skew"), rnd(W.share_positive(c, w), 2).alias("pct_positive"))
    return out.withColumn("range", rnd(F.col("max") - F.col("min"), 4))


def ma_crossover(df: DataFrame, value: str, short: int = cfg.SHORT_WINDOW, long: int = cfg.LONG_WINDOW,
                 min_gap: float = cfg.TREND_GAP, by=tuple(U)) -> DataFrame:
    c, by = F.col(value), list(by)
    a, b = W.mean(c, W.trailing(by, short)), W.mean(c, W.trailing(by, long))
    g = df.select(*by, "date", a.alias("_a"), b.alias("_b")).withColumn(
        "_g", rnd(div(F.col("_a") - F.col("_b"), F.abs("_b")), 12)).withColumn("_pg", F.lag("_g").over(W.ordered(by)))
    gap, prev = F.col("_g"), F.col("_pg")
    cross = ladders.ladder([((gap > min_gap) & (prev <= min_gap), "Bullish"),
                            ((gap < -min_gap) & (prev >= -min_gap), "Bearish")], "")
    return g.select(*by, "date", rnd(F.col("_a"), 4).alias("short_ma"), rnd(F.col("_b"), 4).alias("long_ma"),
                    rnd(gap, 4).alias("gap"), cross.alias("crossover"))


def rolling_corr(df: DataFrame, a: str, b: str, rows: int, by=tuple(U), out: str = "corr") -> DataFrame:
    r = W.corr(F.col(a), F.col(b), W.trailing(list(by), rows), max(3, rows // 2))
    return df.withColumn(out, rnd(r, 4))


def breadth_trend(hist: DataFrame) -> DataFrame:
    b = F.col("breadth_pct")
    ema = with_ewm(hist.select("universe", "date", "breadth_pct", "n_gainers", "n_losers"), U,
                   [span("breadth_ema_7d", "breadth_pct", cfg.SHORT_WINDOW, 2)])
    out = ema.withColumn("breadth_sma_7d", rnd(W.mean(b, W.trailing(U, cfg.SHORT_WINDOW)), 2))
    prev = F.lag("breadth_sma_7d").over(W.ordered(U))
    step = rnd(F.col("breadth_sma_7d") - prev, 6)
    return out.select("universe", "date", "breadth_pct", "breadth_sma_7d", "breadth_ema_7d",
                      (F.col("n_gainers") - F.col("n_losers")).alias("net_breadth"),
                      ladders.ladder([(step > 1.0, "Expanding"), (step < -1.0, "Contracting")], "Stable")
                      .alias("breadth_trend"))


def current_state(hist: DataFrame) -> DataFrame:
    """One row per universe: latest cycle, last crossover, latest breadth trend and residual."""
    def latest(df, order, **cols):
        pick = F.max(F.struct(F.col(order).alias("_o"), *[F.col(v).alias(k) for k, v in cols.items()])).alias("_m")
        return df.groupBy("universe").agg(pick).select("universe", *[F.col(f"_m.{k}").alias(k) for k in cols])

    cycle = latest(market_cycles(hist), "start_date", cycle_direction="direction", cycle_days="length_days",
                   cycle_return="avg_return")
    cross = latest(ma_crossover(hist, "avg_pct").where(F.col("crossover") != ""), "date",
                   last_cross="crossover", last_cross_date="date")
    trend = latest(breadth_trend(hist), "date", breadth_trend="breadth_trend")
    resid = latest(decompose(hist, "avg_pct", cfg.SHORT_WINDOW), "date", residual="residual")
    return (resid.join(trend, "universe", "left").join(cycle, "universe", "left").join(cross, "universe", "left")
            .select("universe", F.coalesce("cycle_direction", F.lit("N/A")).alias("cycle_direction"),
                    F.coalesce("cycle_days", F.lit(0)).alias("cycle_days"),
                    F.coalesce("cycle_return", F.lit(0.0)).alias("cycle_return"),
                    F.coalesce("last_cross", F.lit("None yet")).alias("last_cross"), "last_cross_date",
                    "breadth_trend", "residual"))
