"""Descriptive statistics and rank tests per day.

Ranks and quantiles of a day's cross-section come from
:mod:`tickloom.operators.orderstats`, so a crowded day is not one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom import config as cfg
from tickloom.functions import ladders
from tickloom.functions.numeric import adjusted_kurtosis, adjusted_skew, div, normal_two_sided_p, rnd, student_two_sided_p
from tickloom.operators.orderstats import attach_ranks, average_rank, quantiles, ranked_values

DAY = ["date"]


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count/mean/std/min/quartiles/max of each column, long form: (by, column, statistics)."""
    by = list(by)
    long = df.select(*by, *columns).unpivot(by, list(columns), "column", "value")
    keys = [*by, "column"]
    moments = long.groupBy(*keys).agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                      F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                      F.max("value").alias("max"))
    q = quantiles(long, keys, "value", [0.25, 0.5, 0.75])
    return moments.join(q, keys, "left").select(
        *keys, "count", *[rnd(F.col(c), 2).alias(c) for c in ("mean", "std", "min", "max")],
        rnd(F.col("q0"), 2).alias("p25"), rnd(F.col("q1"), 2).alias("p50"), rnd(F.col("q2"), 2).alias("p75"))


def session_breadth(prices: DataFrame) -> DataFrame:
    """Gain/loss/flat counts and shares, extremes, and medians by side, per day."""
    pct, chg, s = F.col("pct_change"), F.col("change"), F.col("symbol")
    g = prices.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(chg > 0).alias("n_gain"), F.count_if(chg < 0).alias("n_loss"),
        F.count_if(chg == 0).alias("n_flat"), F.avg(pct).alias("_avg"),
        F.min(F.when(pct.isNotNull(), F.struct((-pct).alias("v"), s.alias("s")))).alias("_b"),
        F.min(F.when(pct.isNotNull(), F.struct(pct.alias("v"), s.alias("s")))).alias("_w"),
        F.max("price").alias("price_max"), F.min("price").alias("price_min"))
    sides = prices.select("date", ladders.status(chg).alias("side"), "pct_change", "price").where("side <> 'Flat'")
    long = sides.unpivot(["date", "side"], ["pct_change", "price"], "what", "v")
    med = quantiles(long, ["date", "side", "what"], "v", [0.5]).groupBy("date").agg(*[
        F.max(F.when((F.col("side") == side) & (F.col("what") == what), F.col("q0"))).alias(name)
        for side, what, name in (("Gainer", "pct_change", "gainer_pct_median"), ("Loser", "pct_change", "loser_pct_median"),
                                 ("Gainer", "price", "gainer_price_median"), ("Loser", "price", "loser_price_median"))])

    def share(c):
        return rnd(F.col(c) / F.col("n_total") * 100, 4)

    return g.join(med, "date", "left").select(
        "date", "n_total", "n_gain", "n_loss", "n_flat", share("n_gain").alias("gain_pct"),
        share("n_loss").alias("loss_pct"), share("n_flat").alias("flat_pct"), rnd(F.col("_avg"), 4).alias("avg_chg"),
        F.col("_b.s").alias("top_sym"), rnd(-F.col("_b.v"), 4).alias("top_pct"), F.col("_w.s").alias("bot_sym"),
        rnd(F.col("_w.v"), 4).alias("bot_pct"), "price_max", "price_min",
        *[rnd(F.col(c), 4).alias(c) for c in ("gainer_pct_median", "loser_pct_median", "gainer_price_median",
                                              "loser_price_median")])


def group_means(prices: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    return prices.groupBy(*by, ladders.status(F.col("change")).alias("status")).agg(
        *[rnd(F.avg(c), 2).alias(f"avg_{c}") for c in ("price", "change", "pct_change")])


def iqr_fences(df: DataFrame, value: str, by: Sequence[str] = ("date",)) -> DataFrame:
    q = quantiles(df, by, value, [0.25, 0.75])
    iqr = F.col("q1") - F.col("q0")
    return q.select(*by, F.col("q0").alias("q1"), F.col("q1").alias("q3"), iqr.alias("iqr"),
                    (F.col("q0") - 1.5 * iqr).alias("lower_fence"), (F.col("q1") + 1.5 * iqr).alias("upper_fence"))


def iqr_outliers(df: DataFrame, value: str = "price", by: Sequence[str] = ("date",)) -> DataFrame:
    f = iqr_fences(df, value, by)
    v = F.col(value)
    return df.join(f, list(by)).where((v < F.col("lower_fence")) | (v > F.col("upper_fence")))


def null_dup_audit(prices: DataFrame) -> DataFrame:
    """Nulls per key column, repeated symbols and non-positive prices, per day."""
    cols = ("symbol", "company_name", "price", "change", "pct_change")
    return prices.groupBy("date").agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
        (F.count("symbol") - F.countDistinct("symbol")).alias("duplicate_symbols"),
        F.count_if(F.col("price") <= 0).alias("invalid_prices"))


def with_ranks(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("date",), ids: Sequence[str] = ("symbol",)) -> DataFrame:
    """Average-tie rank ``r_<column>`` of every column within each group; ``ids`` identify a row inside its group.

    The columns are stacked, so one ranking serves them all.
    """
    by, ids = list(by), list(ids)
    long = df.select(*by, *ids, *columns).unpivot([*by, *ids], list(columns), "_col", "_v")
    return attach_ranks(long, [*by, "_col"], "_v", "_rank").groupBy(*by, *ids).agg(*[
        F.max(F.when(F.col("_col") == x, F.col("_rank"))).alias(f"r_{x}") for x in columns])


def spearman(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("date",), ids: Sequence[str] = ("symbol",)) -> DataFrame:
    """Spearman ρ of every column pair per group, with strength, direction, the t statistic, its p-value and significance."""
    by = list(by)
    ranked = with_ranks(df.select(*by, *ids, *columns).dropna(), columns, by, ids)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[
        F.corr(f"r_{a}", f"r_{b}").alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([*by, "n"], [f"{a}|{b}" for a, b in pairs], "pair", "rho")
    rho = rnd(F.when(~F.isnan("rho"), F.col("rho")), 6)
    out = long.select(*by, "n", F.split("pair", r"\|")[0].alias("x"), F.split("pair", r"\|")[1].alias("y"), rho.alias("rho"))
    t = F.when(F.abs("rho") < 1, div(F.col("rho") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0))),
                                     F.sqrt(1 - F.col("rho") * F.col("rho"))))
    p = F.when(F.abs("rho") >= 1, F.lit(0.0)).otherwise(student_two_sided_p(t, F.col("n") - 2))
    p = rnd(F.when(F.col("n") >= 3, p), 4)
    return out.select("*", rnd(t, 6).alias("t_stat"), p.alias("p_value"), F.coalesce(p < cfg.ALPHA, F.lit(False)).alias("significant"),
                      ladders.corr_strength(F.col("rho")).alias("strength"), ladders.corr_direction(F.col("rho")).alias("direction"))


def top_volume(bars: DataFrame, today: Column | str, k: int = 15) -> DataFrame:
    """The ``k`` symbols with stored bars that trade most on ``today``; alphabetically the first where none of them trades that day."""
    known = bars.groupBy("symbol").agg(F.max(F.when(F.col("date") == today, F.col("volume"))).alias("volume"))
    traded = known.agg(F.count("volume").alias("_traded"))  # one row
    ranked = known.withColumn("_k", F.lit(1)).join(F.broadcast(traded.withColumn("_k", F.lit(1))), "_k")
    return (ranked.where((F.col("_traded") == 0) | F.col("volume").isNotNull())
            .orderBy(F.col("volume").desc_nulls_last(), "symbol").limit(k).select("symbol", "volume"))


def pct_discrepancy(prices: DataFrame, threshold: float = cfg.PCT_DISCREPANCY) -> DataFrame:
    """Rows whose percent change differs from the one that price and change imply by more than ``threshold``."""
    d = F.abs(div(F.col("change"), F.col("price") - F.col("change")) * 100 - F.col("pct_change"))
    return prices.withColumn("discrepancy", d).where(F.col("discrepancy") > threshold)


def mann_whitney(prices: DataFrame, value: str = "price", by: Sequence[str] = ("date",)) -> DataFrame:
    """U of gainers against losers per group, with the tie- and continuity-corrected normal test."""
    by = list(by)
    two = prices.select(*by, value, ladders.status(F.col("change")).alias("_side")).where(
        (F.col("_side") != "Flat") & F.col(value).isNotNull())
    # Ranks are needed per distinct value only: a value's gainers all have the same.
    gainers = F.count_if(F.col("_side") == "Gainer")
    sides = ranked_values(two, by, value, extra={"_g": gainers}).groupBy(*by).agg(
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("_ties"), F.sum(average_rank() * F.col("_g")).alias("_rs"),
        F.sum("_g").alias("n_gain"), F.sum(F.col("n") - F.col("_g")).alias("n_loss"))
    a, b = F.col("n_gain").cast("double"), F.col("n_loss").cast("double")
    n = a + b
    u = F.col("_rs") - a * (a + 1) / 2
    sigma = F.sqrt(F.greatest(a * b / 12 * (n + 1 - div(F.col("_ties"), n * (n - 1))), F.lit(0.0)))
    z = div(F.greatest(F.abs(u - a * b / 2) - 0.5, F.lit(0.0)), sigma)
    return (sides.where((a > 0) & (b > 0))
            .select(*by, "n_gain", "n_loss", rnd(u, 1).alias("u_stat"), rnd(z, 6).alias("z"),
                    rnd(normal_two_sided_p(z), 4).alias("p_value"))
            .withColumn("reject", F.coalesce(F.col("p_value") < cfg.ALPHA, F.lit(False))))


def jarque_bera(df: DataFrame, value: str, by: Sequence[str] = ("date",)) -> DataFrame:
    """Normality from moments: JB = n/6 (S² + K²/4), p = exp(-JB/2)."""
    m = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n"), F.skewness(value).alias("_s"), F.kurtosis(value).alias("_k"))
    s, k = F.col("_s"), F.col("_k")
    jb = F.col("n") / F.lit(6.0) * (s * s + k * k / 4)
    return m.where(F.col("n") >= 3).select(*by, "n", rnd(jb, 4).alias("jb"), rnd(F.exp(-jb / 2), 6).alias("p_value")).withColumn(
        "non_normal", F.coalesce(F.col("p_value") < cfg.ALPHA, F.lit(False)))


def tier_counts(prices: DataFrame) -> DataFrame:
    """Count per day and price tier in tier order, with a zero for an empty tier."""
    counted = prices.groupBy("date").agg(*[
        F.count_if(ladders.price_tier(F.col("price")) == t).alias(t) for t in cfg.TIER_LABELS])
    long = counted.select("date", F.explode(F.array(*[
        F.struct(F.lit(i).alias("tier_order"), F.lit(t).alias("price_tier"), F.col(f"`{t}`").alias("n"))
        for i, t in enumerate(cfg.TIER_LABELS)])).alias("_t"))
    return long.select("date", "_t.tier_order", "_t.price_tier", "_t.n")


def box_stats(df: DataFrame, group: Column, name: str, value: str, by: Sequence[str] = ("date",)) -> DataFrame:
    """Five numbers per group: whiskers at the furthest values inside the fences, plus the outlier count."""
    keys = [*by, name]
    d = df.select(*by, group.alias(name), value).where(F.col(name).isNotNull() & F.col(value).isNotNull())
    q = quantiles(d, keys, value, [0.25, 0.5, 0.75])
    iqr, v = F.col("q2") - F.col("q0"), F.col(value)
    inside = (v >= F.col("q0") - 1.5 * iqr) & (v <= F.col("q2") + 1.5 * iqr)
    return d.join(q, keys).groupBy(*keys, "q0", "q1", "q2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"),
        F.count_if(~inside).alias("n_outliers")).select(
        *keys, "n", "n_outliers", *[rnd(F.col(a), 4).alias(b) for a, b in (
            ("low", "whisker_low"), ("q0", "q1"), ("q1", "median"), ("q2", "q3"), ("high", "whisker_high"))])


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ("date",)) -> DataFrame:
    """Equal-width counts over [min, max]; the top edge belongs to the last bin."""
    by, v = list(by), F.col(value)
    lim = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    pos = F.floor(div(v - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    b = F.least(F.coalesce(pos, F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(v.isNotNull()).join(lim, by).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ("date",), min_rows: int = 3) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.corr(x, y)
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r.alias("_r")).select(
        *by, "n", F.when(F.col("n") >= min_rows, rnd(F.when(~F.isnan("_r"), F.col("_r")), 4)).otherwise(F.lit(0.0)).alias("corr"))


def session_scalars(prices: DataFrame) -> DataFrame:
    """Headline numbers and words of each session."""
    pct, chg = F.col("pct_change"), F.col("change")
    g = prices.groupBy("date").agg(
        F.count_if(chg > 0).alias("n_gain"), F.count_if(chg < 0).alias("n_loss"), F.count(F.lit(1)).alias("_n"),
        (F.max(pct) - F.min(pct)).alias("_span"), F.count_if(F.abs(pct) >= 5).alias("high_move_count"),
        F.count_if(F.col("price") < 25).alias("low_price_count"),
        F.min(F.when(chg.isNotNull(), F.struct((-F.abs(chg)).alias("v"), F.col("symbol").alias("s")))).alias("_big"),
        F.skewness("price").alias("_g1"), F.stddev_samp("price").alias("_sd"))
    gain, loss = F.col("n_gain"), F.col("n_loss")
    skew = rnd(adjusted_skew(F.col("_g1"), F.col("_n"), F.col("_sd")), 4)
    return g.select(
        "date", (gain - loss).alias("net_breadth"), rnd(F.col("_span"), 4).alias("volatility_span"), "high_move_count",
        "low_price_count", F.col("_big.s").alias("big_move_symbol"),
        ladders.breadth_label(div(gain, F.col("_n")) * 100).alias("breadth_label"),
        ladders.session_word(gain, loss).alias("session_label"), ladders.momentum_word(gain, loss).alias("momentum_word"),
        ladders.skew_word(skew).alias("skew_label"))


def day_report(prices: DataFrame) -> DataFrame:
    """One wide row of constants per day: descriptives, breadth, tests, fences."""
    moments = prices.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_total"), F.avg("price").alias("_m"), F.stddev_samp("price").alias("_sd"),
        F.skewness("price").alias("_g1"), F.kurtosis("price").alias("_g2"))
    q = quantiles(prices, DAY, "price", [0.25, 0.5, 0.75])
    out = iqr_outliers(prices).groupBy("date").agg(F.count(F.lit(1)).alias("n_outliers"))
    rho = spearman(prices, ["price", "pct_change"]).select("date", F.col("rho").alias("sp_corr"), F.col("p_value").alias("sp_p"),
                                                          F.col("strength").alias("sp_strength"))
    mw = mann_whitney(prices).select("date", "u_stat", F.col("p_value").alias("mw_p"), F.col("reject").alias("mw_reject"))
    n, sd = F.col("n_total"), F.col("_sd")
    return (
        moments.join(q, "date").join(out, "date", "left").join(rho, "date", "left").join(mw, "date", "left")
        .select("date", "n_total", rnd(F.col("_m"), 4).alias("price_mean"), rnd(F.col("q1"), 4).alias("price_median"),
                rnd(sd, 4).alias("price_std"), rnd(adjusted_skew(F.col("_g1"), n, sd), 4).alias("price_skew"),
                rnd(adjusted_kurtosis(F.col("_g2"), n, sd), 4).alias("price_kurt"), rnd(F.col("q0"), 4).alias("q1"),
                rnd(F.col("q2"), 4).alias("q3"), rnd(F.col("q2") - F.col("q0"), 4).alias("iqr"),
                rnd(F.col("q2") + 1.5 * (F.col("q2") - F.col("q0")), 4).alias("upper_fence"),
                F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"), "sp_corr", "sp_p", "sp_strength", "u_stat", "mw_p",
                "mw_reject")
    )
