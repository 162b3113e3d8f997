"""Operator semantics on small hand-made tables, against brute force."""

import datetime as dt

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import ladders
from tickloom.functions.numeric import rnd
from tickloom.operators import (anomalies as N, calendar as C, daily as D, forecast as FC, orderstats as O, preprocess as P,
                                quality as Q, sentiment as SE, signals as G, stats as T)
from tickloom.sources import ingest as ING

DAY0 = dt.date(2024, 1, 1)


def prices(spark, n_days=40, symbols=("A", "B", "C", "D"), seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        level = 100.0
        for i in range(n_days):
            pct = float(rng.normal(0, 2 if i % 11 else 9))
            prev, level = level, level * (1 + pct / 100)
            rows.append(("all", DAY0 + dt.timedelta(days=i), s, s, level, level - prev, pct))
    return spark.createDataFrame(
        rows, "universe string, date date, symbol string, company_name string, price double, change double, pct_change double")


def test_rounding_ties_go_to_even_and_zero_has_no_sign(spark):
    row = spark.createDataFrame([(0.125, 0.375, -0.001, 2.675)], "a double, b double, c double, d double").select(
        rnd(F.col("a"), 2), rnd(F.col("b"), 2), rnd(F.col("c"), 2), rnd(F.col("d"), 2)).first()
    assert row[0] == 0.12 and row[1] == 0.38 and row[3] == 2.68
    assert row[2] == 0.0 and not np.signbit(row[2])


@pytest.mark.parametrize("price, tier", [(0, None), (0.5, "<$10"), (10, "<$10"), (10.01, "$10-25"), (200, "$100-200"),
                                         (9999, ">$200"), (10000, None)])
def test_tiers_are_right_closed(spark, price, tier):
    assert spark.range(1).select(ladders.price_tier(F.lit(float(price)))).first()[0] == tier


# --- order statistics ------------------------------------------------------------------------------------------------

def hot_groups(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": ["hot"] * 4000 + [f"g{i % 40}" for i in range(2000)] + ["one"],
                        "v": np.concatenate([rng.exponential(5, 4000).round(2), rng.normal(0, 1, 2000).round(1), [3.0]])})
    pdf.loc[::97, "v"] = None
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("bin_rows", [5, 60, 8192])
def test_ranks_equal_pandas_ranks(spark, bin_rows):
    pdf, df = hot_groups(spark)
    got = O.ranked_values(df, ["k"], "v", bin_rows).select("k", "v", O.average_rank().alias("r")).toPandas()
    pdf["r"] = pdf.groupby("k").v.rank(method="average")
    want = pdf.dropna().drop_duplicates(["k", "v"])
    m = got.merge(want, on=["k", "v"], suffixes=("", "_w"))
    assert len(m) == len(want) == len(got) and (m.r == m.r_w).all()


@pytest.mark.parametrize("bin_rows, heavy", [(5, 3), (60, 20), (8192, 1024)])
def test_attached_ranks_equal_pandas_ranks(spark, bin_rows, heavy):
    pdf, df = hot_groups(spark)
    ties = pd.DataFrame({"k": "ties", "v": [7.0] * 1900 + list(np.linspace(0, 20, 100).round(1))})  # 95 % of the group share one value
    pdf = pd.concat([pdf, ties], ignore_index=True)
    df = df.unionByName(spark.createDataFrame(ties)).repartition(5)
    got = O.attach_ranks(df, ["k"], "v", "r", bin_rows, heavy).toPandas()
    assert len(got) == len(pdf) and got[got.v.isna()].r.isna().all()
    pdf["w"] = pdf.groupby("k").v.rank(method="average")
    m = got.dropna().merge(pdf.dropna().drop_duplicates(["k", "v"]), on=["k", "v"])
    assert len(m) == len(pdf.dropna()) and (m.r == m.w).all()


def test_no_rank_is_joined_on_a_value(spark):
    p = prices(spark, 12, tuple("ABCDEFGHIJ"))
    for plan in (T.with_ranks(p, ["price", "pct_change"]), T.mann_whitney(p)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in text.splitlines() if "Join" in line]
        assert joins and not any(re.search(r"(_v|price)#\d+ =|= (_v|price)#", line) for line in joins)


def test_bins_grow_with_the_group(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    some = [O._cuts(O.value_counts(df.where(F.col("v") < n), ["k"], "v"), ["k"], "v", 100).select(F.size("_cuts")).collect() for n in (80, 1000, 5000)]
    assert some[0] == [] and 5 <= some[1][0][0] <= 20 and 35 <= some[2][0][0] <= 65
    binned = O._binned(O.value_counts(df, ["k"], "v"), O._cuts(O.value_counts(df, ["k"], "v"), ["k"], "v", 10), ["k"], "v")
    assert max(r["count"] for r in binned.groupBy("_bin").count().collect()) < 60


def test_quantiles_equal_numpy(spark):
    pdf, df = hot_groups(spark)
    probs = [0, 0.05, 0.25, 0.5, 0.9, 1]
    got = O.quantiles(df, ["k"], "v", probs).toPandas().set_index("k")
    for k, g in pdf.dropna().groupby("k"):
        np.testing.assert_allclose(got.loc[k].to_numpy(dtype=float), np.quantile(g.v, probs), rtol=1e-12)
    total = O.quantiles(df, [], "v", [0.5]).first()[0]
    assert total == pytest.approx(pdf.v.median())


def test_spearman_and_mann_whitney_brute_force(spark):
    p = prices(spark, 12, tuple("ABCDEFGHIJ"))
    pdf = p.toPandas()
    got = T.spearman(p, ["price", "pct_change"]).toPandas().set_index("date")
    mw = T.mann_whitney(p).toPandas().set_index("date")
    for day, g in pdf.groupby("date"):
        assert got.loc[day, "rho"] == pytest.approx(g.price.rank().corr(g["pct_change"].rank()), abs=1e-6)
        a, b = g[g.change > 0].price, g[g.change < 0].price
        if len(a) and len(b):
            u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
            assert mw.loc[day, "u_stat"] == pytest.approx(u)


# --- cleaning --------------------------------------------------------------------------------------------------------

def test_clean_bars_order_of_rules(spark):
    raw = spark.createDataFrame([
        ("A", "2024-01-02", "5", "4", "6", "5", "-3", 0), ("A", "2024-01-01", "-1", "9", "2", "3", "7", 1),
        ("A", "2024-01-02", "6", "8", "5", "7", "10", 2), ("A", "2024-01-03", "1", "1", "1", "n/a", "1", 3)],
        "symbol string, date string, open string, high string, low string, close string, volume string, seq int")
    got = P.clean_bars(raw, ["seq"]).orderBy("date").collect()
    assert [tuple(r)[1:] for r in got] == [(dt.date(2024, 1, 1), 0.0, 9.0, 2.0, 3.0, 7.0), (dt.date(2024, 1, 2), 6.0, 8.0, 5.0, 7.0, 10.0)]


def test_split_bounds_are_strict(spark):
    close = [100.0, 59.0, 59.0 * 0.6 / 0.6, 59.0 * 1.68]
    df = spark.createDataFrame([("A", DAY0 + dt.timedelta(days=i), c) for i, c in enumerate(close)], "symbol string, date date, close double")
    assert [r.date.day for r in P.split_detect(df).orderBy("date").collect()] == [2, 4]
    edge = spark.createDataFrame([("A", DAY0, 1.0), ("A", DAY0 + dt.timedelta(days=1), 0.6), ("B", DAY0, 1.0),
                                  ("B", DAY0 + dt.timedelta(days=1), 1.67)], "symbol string, date date, close double")
    assert P.split_detect(edge).count() == 0


def test_gap_fill_stops_at_three_days(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 3), dt.date(2024, 1, 9), dt.date(2024, 1, 16)]  # gaps of 1, 3 and 4 days
    df = spark.createDataFrame([("A", d, 1.0, 1.0, 1.0, float(i), 5.0) for i, d in enumerate(days)],
                               "symbol string, date date, open double, high double, low double, close double, volume double")
    got = P.gap_fill(df).orderBy("date").collect()
    filled = [r.date for r in got if r.filled]
    empty = [r.date for r in got if r.close is None]
    assert filled == [dt.date(2024, 1, 2), dt.date(2024, 1, 4), dt.date(2024, 1, 5), dt.date(2024, 1, 8)]
    assert empty == [dt.date(2024, 1, 10), dt.date(2024, 1, 11), dt.date(2024, 1, 12), dt.date(2024, 1, 15)]
    assert all(r.volume == 0 for r in got if r.filled)


def test_constant_series_normalise(spark):
    df = spark.createDataFrame([("A", 4.0)] * 3, "symbol string, v double")
    for how, want in (("zscore", 0.0), ("robust", 0.0), ("minmax", 0.0)):
        assert {r[0] for r in P.normalise(df, "v", how).select(f"v_{how}").collect()} == {want}


# --- detectors: the latest day of the all-dates result is the direct latest-day computation --------------------------

def test_signals_latest_day_equals_direct(spark):
    p = prices(spark)
    pdf = p.toPandas().sort_values(["symbol", "date"])
    last = pdf.date.max()
    got = {(r.symbol, r.signal_type): r for r in G.all_signals(G.enrich(p)).where(F.col("date") == F.lit(last)).collect()}
    today = pdf[pdf.date == last]
    vols = pdf.groupby("date")["pct_change"].std().round(6)
    baseline = vols[vols.index < last].mean()
    for _, row in today.iterrows():
        h = pdf[(pdf.symbol == row.symbol) & (pdf.date < last)]["pct_change"]
        w = pdf[pdf.symbol == row.symbol]["pct_change"].tail(7)
        z7 = (row["pct_change"] - w.mean()) / w.std()
        z = (row["pct_change"] - h.mean()) / h.std()
        limit = max(today["pct_change"].std(), baseline) * 1.5
        assert ((row.symbol, "momentum_breakout") in got) == (abs(round(z7, 4)) >= 1.5)
        assert ((row.symbol, "unusual_mover") in got) == (abs(z) >= 2)
        assert ((row.symbol, "volatility_spike") in got) == (abs(row["pct_change"]) >= limit)


@pytest.mark.parametrize("days, hit", [(20, False), (21, True)])
def test_price_gap_needs_twenty_days_before(spark, days, hit):
    rows = [("all", DAY0 + dt.timedelta(days=i), "A", "A", 10.0, 0.1, float(1 + i % 2)) for i in range(days - 1)]
    rows.append(("all", DAY0 + dt.timedelta(days=days - 1), "A", "A", 10.0, 1.0, 50.0))
    p = spark.createDataFrame(rows, "universe string, date date, symbol string, company_name string, price double, change double, pct_change double")
    assert (N.price_gap(G.enrich(p)).count() == 1) == hit


@pytest.mark.parametrize("days, hit", [(19, False), (20, True)])
def test_market_anomaly_counts_the_current_day(spark, days, hit):
    rows = [("all", DAY0 + dt.timedelta(days=i), float(1 + i % 2)) for i in range(days - 1)] + [("all", DAY0 + dt.timedelta(days=days - 1), 40.0)]
    h = spark.createDataFrame(rows, "universe string, date date, volatility double")
    assert (N.vol_regime(h).count() == 1) == hit


def test_two_universes_stay_apart(spark):
    p = prices(spark, 15)
    both = p.unionByName(p.withColumn("universe", F.lit("other")).withColumn("pct_change", F.col("pct_change") * 2))
    h = D.rolling_intelligence(D.daily_breadth(both)).toPandas()
    one = D.rolling_intelligence(D.daily_breadth(p)).toPandas().sort_values("date").reset_index(drop=True)
    got = h[h.universe == "all"].sort_values("date").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, one)


def test_streaks_break_on_flat_days(spark):
    sign = [1.0, 1.0, 0.0, 1.0, -1.0, -1.0, None, -1.0]
    h = spark.createDataFrame([("all", DAY0 + dt.timedelta(days=i), s, s) for i, s in enumerate(sign)],
                              "universe string, date date, avg_pct double, streak_sign double")
    got = [(r.start_date.day, r.length, r.direction) for r in D.streaks(h).orderBy("start_date").collect()]
    assert got == [(1, 2, "Bullish"), (4, 1, "Bullish"), (5, 3, "Bearish")]


def test_extreme_sessions_of_one_day(spark):
    h = spark.createDataFrame([("all", DAY0, 1.0)], "universe string, date date, avg_pct double")
    assert [r.direction for r in D.extreme_sessions(h).collect()] == ["Bullish"]


def test_cumulative_survives_a_total_loss(spark):
    p = spark.createDataFrame([("all", DAY0 + dt.timedelta(days=i), "A", v) for i, v in enumerate([10.0, -100.0, 50.0])],
                              "universe string, date date, symbol string, pct_change double")
    assert [r.cum_pct for r in D.cumulative_performance(p).orderBy("date").collect()] == [10.0, -100.0, -100.0]


# --- forecasts, calendar, quality, text ------------------------------------------------------------------------------

def test_linear_forecast_equals_numpy(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(0, 1, 50).cumsum()
    df = spark.createDataFrame([("s", DAY0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)], "k string, date date, v double")
    got = FC.forecast_linear(df, ["k"], "v").orderBy("date").toPandas()
    x = np.arange(30)
    b, a = np.polyfit(x, y[-30:], 1)
    se = (y[-30:] - (a + b * x)).std()
    want = a + b * np.arange(30, 35)
    np.testing.assert_allclose(got.forecast, want, atol=1e-4)
    np.testing.assert_allclose(got.upper_bound, want + 1.96 * se * np.sqrt(np.arange(1, 6) / 30), atol=1e-4)
    assert list(got.date) == [d.date() for d in pd.bdate_range(DAY0 + dt.timedelta(days=50), periods=5)]


def test_short_series_falls_back_to_the_mean(spark):
    df = spark.createDataFrame([("s", DAY0, 1.0), ("s", DAY0 + dt.timedelta(days=1), 3.0)], "k string, date date, v double")
    assert {r.forecast for r in FC.forecast_linear(df, ["k"], "v").collect()} == {2.0}


def test_holidays_of_many_years(spark):
    got = {(r.year, r.holiday): r.date for r in C.holidays(spark.range(2000, 2041).select(F.col("id").cast("int").alias("year"))).collect()}
    assert len(got) == 41 * 10
    good_fridays = {2000: (4, 21), 2008: (3, 21), 2011: (4, 22), 2019: (4, 19), 2024: (3, 29), 2025: (4, 18), 2038: (4, 23)}
    for y, (m, d) in good_fridays.items():
        assert got[y, "Good Friday"] == dt.date(y, m, d)
    for y in range(2000, 2041):
        def nth(month, wd, n):
            days = [dt.date(y, month, 1) + dt.timedelta(days=i) for i in range(31)]
            return [x for x in days if x.month == month and x.weekday() == wd][n]
        assert got[y, "Martin Luther King"] == nth(1, 0, 2) and got[y, "Labor"] == nth(9, 0, 0)
        assert got[y, "Thanksgiving"] == nth(11, 3, 3) and got[y, "Memorial"] == nth(5, 0, -1)
        assert all(v.weekday() < 5 for k, v in got.items() if k[0] == y)


def test_last_closed_day_skips_weekend_and_holiday(spark):
    ts = ["2024-01-16 20:59:00", "2024-01-16 21:00:00", "2024-01-13 15:00:00", "2024-07-05 19:59:00", "2024-07-05 20:01:00"]
    df = spark.createDataFrame([(t,) for t in ts], "t string").select("t", F.col("t").cast("timestamp_ntz").alias("ts"))
    got = {r.t: r.last_closed for r in C.last_closed_day(df, "ts").collect()}
    assert got[ts[0]] == dt.date(2024, 1, 12)  # the 15th is a holiday
    assert got[ts[1]] == dt.date(2024, 1, 16) and got[ts[2]] == dt.date(2024, 1, 12)
    assert got[ts[3]] == dt.date(2024, 7, 3) and got[ts[4]] == dt.date(2024, 7, 5)


def test_duplicate_rate_decides_severity(spark):
    p = prices(spark, 60)
    assert {r.check: r.severity for r in Q.dq_prices(p.unionByName(p.limit(1))).collect()}["duplicate_keys"] == "warning"
    assert {r.check: r.severity for r in Q.dq_prices(p.unionByName(p)).collect()}["duplicate_keys"] == "error"


def test_html_fallbacks_and_unreadable_rows(spark):
    html = ("<table><tr><td>X</td><td>X Co, Ltd</td><td>1,234.5 -2 (-0.16%)</td></tr>"
            "<tr><td>Y</td><td>Y</td><td>15</td><td>n/a</td></tr>"
            "<tr><td>Z</td><td>Z</td><td>20</td><td>1</td><td>5.26%</td></tr><tr><td>Symbol</td><td>a</td><td>b</td></tr></table>")
    df = spark.createDataFrame([(html,)], "html string")
    got = {r.symbol: r for r in ING.html_rows(df).collect()}
    assert set(got) == {"X", "Y", "Z"}
    assert (got["X"].price, got["X"].change, got["X"].pct_change, got["X"].company_name) == (1234.5, -2.0, -0.16, "X Co Ltd")
    assert got["Y"].change is None and ING.readable(ING.html_rows(df)).count() == 2
    assert got["Z"].pct_change == 5.26


def test_representative_headline_is_nearest_the_mean(spark):
    h = spark.createDataFrame([("A", DAY0, 1, "up", 0.9), ("A", DAY0, 2, "flat", 0.1), ("A", DAY0, 3, "down", -0.7), ("A", DAY0, 4, "flat too", 0.1)],
                              "symbol string, date date, doc_id int, headline string, score double")
    r = SE.headline_sentiment(h, ["doc_id"]).first()
    assert (r.top_headline, r.headlines_used, r.sentiment_score, r.sentiment_label) == ("flat", 4, 0.1, "Bullish")


def test_model_scorer_batches_and_falls_back(spark):
    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("cannot score")
            return [len(t) / 10 for t in texts]
        return model

    score = SE.model_score(load, fallback=lambda ts: [-1.0] * len(ts), batch=1)
    df = spark.createDataFrame([("abc",), ("bad",)], "t string").coalesce(1)
    assert {r.t: r.s for r in df.select("t", score("t").alias("s")).collect()} == {"abc": 0.3, "bad": -1.0}


def test_long_symbol_ids_keep_their_digits(spark):
    from tickloom.sources import sample
    got = spark.createDataFrame([(7,), (1234,), (12345,), (12340,), (1234567,)], "user_id bigint").select(sample.event_symbol().alias("s"))
    assert [r.s for r in got.collect()] == ["U0007", "U1234", "U12345", "U12340", "U1234567"]


def test_selection_drops_rows_incomplete_among_the_survivors(spark):
    from tickloom.operators import features as X
    rows = [(1.0, 1.0, 5.0), (2.0, -1.0, None), (3.0, 2.0, 5.0), (4.0, 1.5, None), (5.0, 3.0, 5.0), (2.5, 4.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, flat double")
    assert [r.feature for r in X.select_features(df, ["a", "b", "flat"]).orderBy("position").collect()] == ["a", "b"]
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert not any(r.kept for r in X.variance_filter(one, ["a", "b"]).collect())
    assert all(r.kept for r in X.variance_filter(one.limit(0), ["a", "b"]).collect())


def test_student_p_values(spark):
    from tickloom.functions.numeric import student_two_sided_p
    # (t, degrees of freedom, two-sided p): tabulated 5 % and 1 % points, and t = 0
    known = [(12.7062, 1, 0.05), (4.3027, 2, 0.05), (2.5706, 5, 0.05), (2.2281, 10, 0.05), (63.6567, 1, 0.01), (3.1693, 10, 0.01),
             (1.9840, 100, 0.05), (2.6259, 100, 0.01), (0.0, 7, 1.0), (1.9623, 1000, 0.05), (1.9612, 2000, 0.05)]
    df = spark.createDataFrame([(float(t), n, p) for t, n, p in known], "t double, n int, p double")
    for r in df.select("p", student_two_sided_p(F.col("t"), F.col("n")).alias("got")).collect():
        assert abs(r.got - r.p) < 5e-5


def test_a_small_lexicon_never_shuffles_texts_by_token(spark, sf):
    from tickloom.plans.catalogue import QUERIES
    from tickloom.streaming.runtime import setting
    with setting(spark, "spark.sql.shuffle.partitions", "200"):
        df = QUERIES["headline_scores_joined"](spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" not in plan[:plan.find("Initial Plan")]
    assert {r.score for r in df.collect()} != {0.0}
