"""Window-sum exponential weighting against the pandas recursion."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tickloom.operators import ewm as E, indicators as I


def frame(spark, series: dict[str, list]):
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for k, xs in series.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, date date, x double")


def expect(xs, alpha, min_rows):
    return pd.Series(xs, dtype="float64").ewm(alpha=alpha, adjust=False, min_periods=min_rows).mean()


def check(spark, series, specs, **kw):
    got = E.with_ewm(frame(spark, series), ["symbol"], specs, **kw).toPandas()
    for k, xs in series.items():
        g = got[got.symbol == k].sort_values("date")
        for s in specs:
            want = expect(xs, s.alpha, s.min_rows)
            np.testing.assert_allclose(g[s.out].to_numpy(dtype=float), want.to_numpy(), rtol=1e-12, atol=1e-12)


RNG = np.random.default_rng(7)
SPECS = [E.Ewm("a", "x", 0.25, 1, None), E.Ewm("b", "x", 1 / 14, 14, None), E.Ewm("c", "x", 2 / 31, 1, None)]


def gaps(n, share):
    xs = RNG.normal(100, 20, n)
    return [None if RNG.random() < share else float(v) for v in xs]


@pytest.mark.parametrize("block", [None, 900])
def test_complete_series(spark, block):
    series = {"long": [float(v) for v in RNG.normal(50, 9, 3000)], "short": [1.5], "flat": [3.25] * 900}
    check(spark, series, SPECS, block=block)
    check(spark, series, SPECS, block=block, nulls=False)


@pytest.mark.parametrize("block", [None, 1000])
def test_missing_values(spark, block):
    series = {"lead": [None] * 7 + gaps(60, 0), "few": gaps(2600, 0.1), "many": gaps(2600, 0.6),
              "hole": gaps(40, 0) + [None] * 300 + gaps(40, 0), "none": [None] * 5, "tail": gaps(30, 0) + [None] * 9}
    check(spark, series, SPECS, block=block)


def test_series_longer_than_one_block_carries_over(spark):
    xs = [float(v) for v in RNG.normal(0, 1, 5000)]
    check(spark, {"s": xs}, [E.Ewm("a", "x", 0.3, 1, None)])
    assert E.block_rows([E.Ewm("a", "x", 0.3)]) < 5000


def test_sparse_series_and_any_block_size(spark):
    xs = [float(v) if RNG.random() < 0.05 else None for v in RNG.normal(1000, 50, 1500)]
    specs = [E.Ewm("a", "x", 1 / 19, 1, None), E.Ewm("b", "x", 0.7, 1, None), E.Ewm("c", "x", 0.001, 3, None)]
    for block in (1, 50, 333):
        check(spark, {"sparse": xs, "full": [float(v) for v in RNG.normal(5, 1, 400)]}, specs, block=block)
    check(spark, {"full": [float(v) for v in RNG.normal(5, 1, 400)]}, specs, block=50, nulls=False)


def test_alpha_per_row(spark):
    df = frame(spark, {"p": [1.0, 2.0, 4.0], "q": [1.0, 2.0, 4.0]})
    alpha = F.when(F.col("symbol") == "p", F.lit(0.5)).otherwise(F.lit(0.25))
    got = E.with_ewm(df, ["symbol"], [E.Ewm("y", "x", alpha, 1, None, (0.25, 0.5))]).toPandas()
    for k, a in (("p", 0.5), ("q", 0.25)):
        np.testing.assert_allclose(got[got.symbol == k].sort_values("date").y, expect([1.0, 2.0, 4.0], a, 1))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.one_of(st.none(), st.floats(-1000, 1000)), min_size=1, max_size=60))
def test_average_stays_within_the_data(spark, xs):
    got = E.with_ewm(frame(spark, {"s": xs}), ["symbol"], [E.Ewm("y", "x", 0.25, 1, None)]).orderBy("date").toPandas().y
    known = [x for x in xs if x is not None]
    if known:
        assert got.dropna().between(min(known) - 1e-9, max(known) + 1e-9).all()
    np.testing.assert_allclose(got.to_numpy(dtype=float), expect(xs, 0.25, 1).to_numpy(), rtol=1e-9, atol=1e-9)


# --- indicators against plain pandas ---------------------------------------------------------------------------------

def bars(n=320, seed=3):
    rng = np.random.default_rng(seed)
    close = np.round(np.exp(np.cumsum(rng.normal(0, 0.02, n))) * 50, 2)
    high = np.round(close * (1 + rng.random(n) * 0.02), 2)
    low = np.round(close * (1 - rng.random(n) * 0.02), 2)
    days = pd.bdate_range("2020-01-01", periods=n).date
    return pd.DataFrame({"symbol": "S", "date": days, "open": close, "high": high, "low": low, "close": close,
                         "volume": rng.integers(100, 999, n).astype(float)})


def wilder(s, n):
    return s.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()


def test_rsi_atr_adx(spark):
    p = bars()
    df = spark.createDataFrame(p)
    d = p.close.diff()
    rsi = 100 - 100 / (1 + wilder(d.clip(lower=0), 14) / wilder((-d).clip(lower=0), 14).replace(0, np.nan))
    np.testing.assert_allclose(I.rsi(df).orderBy("date").toPandas().rsi, rsi.round(4), atol=1.01e-4)
    pc = p.close.shift()
    tr = pd.concat([p.high - p.low, (p.high - pc).abs(), (p.low - pc).abs()], axis=1).max(axis=1)
    np.testing.assert_allclose(I.atr(df).orderBy("date").toPandas().atr, wilder(tr, 14).round(4), atol=1.01e-4)
    up, dn = p.high.diff(), -p.low.diff()
    plus = (100 * wilder(pd.Series(np.where((up > dn) & (up > 0), up, 0.0)), 14) / wilder(tr, 14)).round(4)
    minus = (100 * wilder(pd.Series(np.where((dn > up) & (dn > 0), dn, 0.0)), 14) / wilder(tr, 14)).round(4)
    dx = (100 * (plus - minus).abs() / (plus + minus).replace(0, np.nan)).round(4)
    got = I.adx(df).orderBy("date").toPandas()
    np.testing.assert_allclose(got.plus_di, plus, atol=1.01e-4)
    np.testing.assert_allclose(got.adx_14, wilder(dx, 14).round(4), atol=1.01e-3)
    assert got.adx_14.first_valid_index() == 26 and got.plus_di.first_valid_index() == 13


def test_rsi_is_null_without_losses(spark):
    p = bars(40)
    p["close"] = np.arange(40) + 1.0
    assert I.rsi(spark.createDataFrame(p)).toPandas().rsi.isna().all()


@pytest.mark.parametrize("n, base", [(63, True), (64, False)])
def test_regime_needs_a_quarter_of_returns(spark, n, base):
    p = bars(n)
    # The newest quarter is far calmer than nothing before it: with exactly 63 returns there is one quarter to rank in.
    got = I.regime_windows(spark.createDataFrame(p)).first()
    assert (got.mult == 1.0) if base else (got.mult in (0.70, 1.35))


def test_suite_is_the_same_with_and_without_the_completeness_promise(spark):
    df = spark.createDataFrame(pd.concat([bars(150), bars(90, 5).assign(symbol="T")]))
    a = I.indicator_suite(df).orderBy("symbol", "date").toPandas()
    b = I.indicator_suite(df, complete=True).orderBy("symbol", "date").toPandas()[a.columns]
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)
    assert a.drawdown_pct.max() <= 0 and a.rsi_14.dropna().between(0, 100).all()
