"""Incremental work against the full run: co-moments, day moments, live baselines, indicator state and snapshots, stream dedup."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import comoments as M, daily as D, features as X, indicators as I, resume as RS, signals as G
from tickloom.streaming import detectors as LD, exact as EX, indicator_state as IS, moments as MO, ticks as TK
from tickloom.streaming.runtime import setting
from tickloom.streaming.versioned import Versioned

DAY0 = dt.date(2022, 1, 3)


def bars(spark, days=90, symbols="AB", seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        close = 50 + np.cumsum(rng.normal(0, 1, days)).round(2)
        for i, x in enumerate(close):
            hi, lo = x + float(rng.integers(0, 9)) / 4, x - float(rng.integers(0, 9)) / 4
            rows.append((s, DAY0 + dt.timedelta(days=i), float(x), float(hi), float(lo), float(x), float(rng.integers(1, 99))))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def frame(df, keys=("symbol", "date")):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


# --- co-moments ---------------------------------------------------------------------------------------------------------


def holed(spark, n=400):
    rng = np.random.default_rng(8)
    x = rng.normal(3, 2, (n, 5))
    x[:, 1] = 2 * x[:, 0] + 0.01 * x[:, 1]
    x[:, 3] = 7.25  # constant
    x[rng.random((n, 5)) < 0.1] = np.nan
    x[:, 4] = np.where(np.arange(n) < n // 2, np.nan, x[:, 4])
    pdf = pd.DataFrame(x, columns=list("abcde"))
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abcde"])
    return pdf, df.repartition(7)


def test_comoments_of_complete_rows_equal_numpy(spark):
    pdf, df = holed(spark)
    patterns = M.comoments(df, list("abcde"))
    rows = patterns.collect()
    assert sum(r.n for r in rows) == len(pdf) and len({tuple(r.missing) for r in rows}) == len(rows)
    for wanted in ((True,) * 5, (True, True, True, True, False), (False, False, True, False, True), (False, True, False, False, False), (False,) * 5):
        some = [c for c, w in zip("abcde", wanted) if w]
        one = spark.createDataFrame([(list(wanted),)], "wanted array<boolean>")
        got = M.complete_over(patterns, one).first()
        whole = pdf[some].dropna()
        assert got.n == len(whole)
        at = [k for k, w in enumerate(wanted) if w]
        if some:
            want = np.cov(whole.to_numpy().T, ddof=0).reshape(len(some), -1) * len(whole)
            np.testing.assert_allclose(np.reshape(got.product, (5, 5))[np.ix_(at, at)], want, rtol=1e-10, atol=1e-9)
            np.testing.assert_allclose(np.asarray(got.mean)[at], whole.mean(), rtol=1e-12)


def test_selection_reads_its_rows_once_and_equals_the_chain(spark):
    pdf, df = holed(spark)
    got = X.select_features(df, list("abcde"))
    assert [(r.feature, r.position) for r in got.orderBy("position").collect()] == [("a", 1), ("c", 3), ("e", 5)]
    v = {r.feature: r.variance for r in X.variance_filter(df, list("abcde")).collect()}
    np.testing.assert_allclose([v[c] for c in "abcde"], pdf.dropna().var(), rtol=1e-10)
    assert v["d"] == 0.0
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan[:plan.find("Initial Plan")].count("MapInArrow ") <= 1


def test_merge_does_not_depend_on_the_grouping():
    x = np.random.default_rng(1).normal(1e6, 1, (60, 3))
    whole = M._block(x)
    for cut in (1, 7, 59):
        n, mean, product = M.merge([M._block(x[:cut]), M._block(x[cut:])])
        assert n == 60 and np.allclose(mean, whole[1], rtol=1e-14) and np.allclose(product, whole[2], rtol=1e-8)


def test_comoments_of_nothing(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert M.complete(M.comoments(df, ["a", "b"])).first().n == 0
    assert {r.feature for r in X.variance_filter(df, ["a", "b"]).where("kept").collect()} == {"a", "b"}
    assert X.select_features(df, ["a", "b"]).count() == 2
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert X.select_features(one, ["a", "b"]).count() == 0


# --- streams ------------------------------------------------------------------------------------------------------------


def prices(spark, days=40, symbols="ABCDEFGH", seed=2):
    rng = np.random.default_rng(seed)
    rows = [("all", DAY0 + dt.timedelta(days=i), s, float(p), float(p)) for i in range(days) for s in symbols
            for p in [rng.normal(0, 9 if rng.random() < 0.08 else 1)]]
    rows += [("all", DAY0 + dt.timedelta(days=3), "NULL", None, None), ("flat", DAY0, "A", 1.5, 1.5), ("flat", DAY0, "B", 1.5, 1.5)]
    return spark.createDataFrame(rows, "universe string, date date, symbol string, change double, pct_change double")


@pytest.mark.parametrize("every", [1, 3, 100])
def test_day_moments_in_any_order_equal_one_run(spark, tmp_path, every):
    p = prices(spark)
    table = Versioned(str(tmp_path / "days"), MO.SCHEMA, MO.KEY, every)
    write = MO.moment_sink(table)
    parts = p.randomSplit([1.0] * 5, 3)
    for k, part in enumerate(parts):
        write(part, k)
    write(parts[4], 4)  # written twice
    got, want = frame(MO.daily_from_moments(table.before(spark, 5)), ("universe", "date")), frame(D.daily_breadth(p), ("universe", "date"))
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_live_detectors_equal_the_all_dates_run(spark, tmp_path):
    p = prices(spark, 60).where("universe = 'all'").drop("change")
    sink = LD.live_sink(str(tmp_path), every=2)
    for k in range(4):
        sink(p.where(F.datediff("date", F.lit(DAY0)).between(15 * k, 15 * k + 14)), k)
    late = p.where(F.col("date") == F.lit(DAY0 + dt.timedelta(days=5)))
    sink(late, 4)
    sink(late, 4)
    got = frame(spark.read.schema(LD.OUT).parquet(str(tmp_path / "out")).drop("batch"), ("detector", "symbol", "date"))
    whole = G.enrich(p.withColumns({"price": F.lit(1.0), "change": F.lit(0.0), "company_name": F.col("symbol")}))
    want = frame(LD.judge(whole), ("detector", "symbol", "date"))
    assert set(got.detector) == {"volatility_spike", "unusual_mover", "price_gap"}
    pd.testing.assert_frame_equal(got[want.columns], want)
    assert spark.read.parquet(str(tmp_path / "late")).count() == late.count()


def test_detectors_read_their_rows_once(spark):
    p = prices(spark, 30).drop("change")
    stored = p.select("*", F.lit(None).cast("long").alias("_sn"), *[F.lit(None).cast("double").alias(x) for x in ("_smean", "_sm2")])
    plan = LD.judge(LD.live_enrich(stored, spark.createDataFrame([], LD.MARKET)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [count(pct_change") == 1 and "Union" not in plan  # one pass for the three detectors


def test_a_repeat_weeks_later_adds_nothing(spark, tmp_path):
    seen = EX.SeenKeys(spark, str(tmp_path), "id long, kind string", 4)
    sink = EX.exact_sink(seen, str(tmp_path / "first"))
    rows = [[(1, "a", 1), (2, "a", 1), (2, "a", 2), (None, "a", 1)], [(1, "b", 3), (1, "a", 9), (None, "a", 9)], [(2, "a", 30), (7, None, 30)], [(7, None, 31)]]
    for k, r in enumerate(rows):
        batch = spark.createDataFrame(r, "id long, kind string, day int")
        sink(batch, k)
        sink(batch, k)  # every batch is written twice
    got = spark.read.parquet(str(tmp_path / "first")).select("batch", "id", "kind").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(0, 1, "a"), (0, 2, "a"), (0, None, "a"), (1, 1, "b"), (2, 7, None)], key=repr)
    plan = seen.unseen(batch, 9)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount" in plan or "Bucketed: true" in plan or "BroadcastHashJoin" in plan
    spark.sql(f"DROP TABLE {seen.name}")


def test_averages_from_a_state_equal_the_recursion():
    x = np.random.default_rng(5).normal(10, 3, 700)
    for alpha in (1 / 14, 0.5, 0.9):
        want, y = [], None
        for v in x:
            y = v if y is None else (1 - alpha) * y + alpha * v
            want.append(y)
        np.testing.assert_allclose(IS.averaged(None, x, alpha), want, rtol=1e-11)
        np.testing.assert_allclose(IS.averaged(want[99], x[100:], alpha), want[100:], rtol=1e-11)


COLS = ["ema_12", "ema_26", "macd", "macd_signal", "macd_hist", "rsi_14", "atr_14"]


@pytest.mark.parametrize("stored", [0, 30])
def test_indicator_state_equals_the_suite(spark, tmp_path, stored):
    b = bars(spark, 60).select("symbol", "date", "high", "low", "close")
    day = F.datediff("date", F.lit(DAY0))
    initial = IS.initial_state(b.where(day < stored), tail=20) if stored else None
    wrong = b.where(day == 44).withColumn("close", F.col("close") + 3)  # corrected by a later batch
    batches = [b.where((day >= stored) & (day < 45) & (day != 41) & (day != 44)), b.where(day.between(45, 52)).unionByName(wrong), b.where((day == 41) | (day == 44)),
               b.where(day > 52).unionByName(b.where(day == 2))]
    path = str(tmp_path / "in")
    for x in batches:
        x.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with pytest.raises(ValueError, match="RocksDB"):
        IS.run_indicators(stream, str(tmp_path / "no"), initial)
    with setting(spark, IS.PROVIDER, IS.ROCKSDB):
        got = frame(IS.run_indicators(stream, str(tmp_path / "job"), initial, tail=20))
    assert got[got.late].date.unique().tolist() == [DAY0 + dt.timedelta(days=2)]  # older than the state's tail: for a stored run
    want = frame(I.indicator_suite(b.withColumns({"open": F.col("close"), "volume": F.lit(1.0)}))).merge(got[["symbol", "date"]])
    on_time = ~got.late
    pd.testing.assert_frame_equal(got.loc[on_time, COLS].reset_index(drop=True), want.loc[on_time.values, COLS].reset_index(drop=True))


def test_indicators_of_whole_batches_equal_the_suite(spark, tmp_path):
    stored, b = 30, bars(spark, 60, "ABC").select("symbol", "date", "high", "low", "close")
    day = F.datediff("date", F.lit(DAY0))
    b = b.where((F.col("symbol") != "C") | (day >= 40))  # C has no state at first
    initial = IS.initial_state(b.where(day < stored), tail=20)
    wrong = b.where(day == 44).withColumn("close", F.col("close") + 3)  # corrected by a later batch
    batches = [b.where((day >= stored) & (day < 45) & (day != 41) & (day != 44)), b.where(day.between(45, 52)).unionByName(wrong), b.where((day == 41) | (day == 44)),
               b.where(day > 52).unionByName(b.where(day == 2))]
    path, base = str(tmp_path / "in"), str(tmp_path / "job")
    for x in batches:
        x.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = frame(IS.run_indicators_by_batch(stream, base, initial, tail=20, every=3))
    assert sorted(set(got[got.late].symbol)) == ["A", "B"] and got[got.late].date.unique().tolist() == [DAY0 + dt.timedelta(days=2)]
    want = frame(I.indicator_suite(b.withColumns({"open": F.col("close"), "volume": F.lit(1.0)}))).merge(got[["symbol", "date"]])
    on_time = ~got.late
    pd.testing.assert_frame_equal(got.loc[on_time, COLS].reset_index(drop=True), want.loc[on_time.values, COLS].reset_index(drop=True))
    table = Versioned(base + "/states", IS.STATE, ("symbol",), 3)
    before = frame(table.before(spark, 5), ["symbol"])
    IS.indicator_sink(base, 20, 3)(batches[3], 3)  # the last batch once more
    pd.testing.assert_frame_equal(frame(spark.read.schema(IS.OUT).parquet(base + "/table"))[list(got.columns)], got)
    pd.testing.assert_frame_equal(frame(table.before(spark, 5), ["symbol"]), before)
    rows = IS.continued(IS.arrived(batches[3], table.before(spark, 4)))
    assert "Pandas" not in rows._jdf.queryExecution().executedPlan().toString()  # no Python call per symbol


def test_averages_of_whole_batches_equal_the_recursion(spark, tmp_path):
    b = bars(spark, 40, "ABC").select("symbol", "date", "close")
    day = F.datediff("date", F.lit(DAY0))
    batches = [b.where((day < 20) & (F.col("symbol") != "C")), b.where((day == 5) | day.between(20, 24)),
               b.where(day == 25).unionByName(b.where(day == 25)), b.where(day > 25).withColumn("close", F.when((day != 30), F.col("close")))]
    sink = TK.ema_sink(str(tmp_path), every=2)
    for k, x in enumerate(batches):
        sink(x, k)
        sink(x, k)  # every batch is written twice
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    # C is new in the second batch, so that its early day is none too late; the 30th close is missing.
    assert sorted(zip(got[got.late].symbol, (pd.to_datetime(got[got.late].date) - pd.Timestamp(DAY0)).dt.days)) == [
        ("A", 5), ("A", 25), ("B", 5), ("B", 25), ("C", 25)]
    for s, rows in got[~got.late].sort_values("date").groupby("symbol"):
        y = None
        for close, ema in zip(rows.close, rows.ema):
            if close != close:
                assert ema != ema
                continue
            y = close if y is None else 0.75 * y + 0.25 * close
            assert abs(ema - y) < 1e-9
    plan = TK.ema_rows(batches[1], spark.createDataFrame([], TK.EMA_STATE))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan  # no Python call per symbol


# --- snapshots ----------------------------------------------------------------------------------------------------------


def quarterly(date):
    return F.year(date) * 10 + F.quarter(date)


@pytest.mark.parametrize("shock", [0.0, 40.0])
def test_rerun_from_a_snapshot_equals_the_full_run(spark, tmp_path, shock):
    b = bars(spark, 700, "ABC").withColumn("block", quarterly(F.col("date")))
    late = dt.date(2023, 6, 15)
    # With the large factor the late days move symbol A to another volatility regime.
    noisy = F.when((F.col("symbol") == "A") & (F.col("date") > F.lit(late)), F.col("close") + shock * (F.dayofmonth("date") % 2)).otherwise(F.col("close"))
    now = b.withColumn("close", noisy).withColumn("high", F.greatest("high", "close"))
    was = b.where((F.col("date") != F.lit(late)) | (F.col("symbol") == "C"))
    now.write.partitionBy("block").parquet(str(tmp_path / "bars"))
    stored = spark.read.schema(now.schema).parquet(str(tmp_path / "bars"))
    _, states = RS.full_run(was.drop("block"), quarterly)
    states.write.parquet(str(tmp_path / "snaps"))
    snaps = spark.read.schema(states.schema).parquet(str(tmp_path / "snaps"))
    changed = now.where((F.col("date") >= F.lit(late)) & (F.col("symbol") != "C")).select("symbol", "date")
    got, new = RS.rerun(stored, snaps, changed, quarterly)
    pdf = frame(got)
    assert set(pdf.symbol) == {"A", "B"} and pdf[pdf.symbol == "B"].date.min() == dt.date(2023, 4, 1)
    assert (pdf[pdf.symbol == "A"].date.min() == DAY0) == (shock == 40.0)
    want = frame(I.indicator_suite(now.drop("block"))).merge(pdf[["symbol", "date"]])
    pd.testing.assert_frame_equal(pdf[want.columns], want, rtol=1e-9, atol=2e-4)
    if shock == 0.0:
        full = {(r.symbol, r.block): (r.mult, r.n_returns, len(r.tail)) for r in RS.full_run(now.drop("block"), quarterly)[1].collect()}
        assert all(full[(r.symbol, r.block)] == (r.mult, r.n_returns, len(r.tail)) for r in new.collect())
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "block#" in plan and "20232" in plan


# --- scoring ------------------------------------------------------------------------------------------------------------


def test_failing_texts_stand_alone_and_models_load_once(spark, tmp_path):
    from tickloom.operators import scoring as SR
    log = tmp_path / "loads"

    def load():
        with open(log, "a") as f:
            f.write("x")

        def model(texts):
            if len({len(t) // 100 for t in texts}) > 2:
                raise AssertionError("texts of very different lengths in a batch")
            if any("bad" in t for t in texts):
                raise ValueError("cannot read " + next(t for t in texts if "bad" in t)[:3])
            return [len(t) / 10 for t in texts]

        return model

    rows = [(k, "x" * (k % 40) if k % 3 else "y" * 900) for k in range(60)] + [(60, None), (61, "bad one"), (62, ""), (63, "bad two")]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {r.id: r for r in SR.scored(df.repartition(3), "text", load, batch=8).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        bad = t is not None and "bad" in t
        assert got[k].score == (None if t is None or bad else round(len(t) / 10, 4))
        assert got[k].error == ("ValueError: cannot read bad" if bad else None)
    assert 1 <= len(log.read_text()) <= 4  # at most once per worker process


def test_a_model_that_returns_too_few_scores_is_an_error(spark):
    from tickloom.operators import scoring as SR
    got = SR.scored(spark.createDataFrame([("a",), ("b",)], "text string"), "text", lambda: lambda texts: []).collect()
    assert all(r.score is None and r.error == "ValueError: 0 scores for 1 texts" for r in got)
