"""RSI, MACD and ATR of bars that arrive in batches, from state instead of a recomputation.

A symbol's state is one typed value, the *base* (date, close and number of rows, the running averages, and its window sizes), and a list,
the *tail*: the newest ``tail`` rows, which are not in the base yet.  A batch's rows are put in their places in the tail, whether they are
new days, days that come late or corrected days; the averages run again from the base over the tail, and every row from the first changed
one on is emitted.  Then all but the newest rows move into the base.  A day older than the base is emitted with ``late`` set and no
indicators: its symbol needs a run from the stored bars, whose result is the next initial state (:func:`initial_state`).

Averages over a stretch are window sums in closed form, as in :mod:`tickloom.operators.ewm`, with arrays instead of a loop over rows.
The state needs a store that holds lists, which the RocksDB provider is; :func:`run_indicators` refuses to start on another.

That way calls Python and the store for each symbol of a batch, some 50 ms together, which suits batches of few symbols.  Batches that
touch most symbols go through :func:`run_indicators_by_batch`: the same state is one row per symbol of a versioned table, the averages of
all symbols are window sums in the JVM, and a symbol costs its rows.  Of a day that one batch brings twice, that keeps the greater row.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom import config as cfg
from tickloom.functions.numeric import div
from tickloom.operators import ewm as E, indicators as I
from tickloom.streaming.ticks import upsert_sink
from tickloom.streaming.runtime import drain, exists
from tickloom.streaming.versioned import Versioned

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TAIL = 40
SIZES = ("fast", "slow", "signal", "rsi", "atr")
STANDARD = (cfg.MACD_FAST, cfg.MACD_SLOW, cfg.MACD_SIGNAL, cfg.RSI_WINDOW, cfg.ATR_WINDOW)
AVERAGES = ("ema_fast", "ema_slow", "ema_signal", "gain", "loss", "range")
BASE = "date date, n long, close double, " + ", ".join(f"{a} double" for a in AVERAGES) + ", " + ", ".join(f"{s} int" for s in SIZES)
BAR = "date date, high double, low double, close double"
OUT = ("symbol string, date date, ema_12 double, ema_26 double, macd double, macd_signal double, macd_hist double, rsi_14 double, "
       "atr_14 double, late boolean")
_STRETCH = 128


def rounded(x: np.ndarray, n: int) -> np.ndarray:
    """Half-even rounding with decimal ties, as :func:`tickloom.functions.numeric.rnd`."""
    k = 10.0**n
    return np.rint(np.rint(x * (k * 1e6)) / 1e6) / k + 0.0


def averaged(before: float | None, x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential average of ``x`` that goes on from ``before``; without one the first value starts it."""
    out = np.empty(len(x))
    for a in range(0, len(x), _STRETCH):
        part = x[a:a + _STRETCH]
        fall = (1 - alpha) ** np.arange(1, len(part) + 1)
        start = part[0] if before is None else before
        out[a:a + len(part)] = fall * (start + np.cumsum(alpha * part / fall))
        before = out[a + len(part) - 1]
    return out


def run_from(base: tuple, tail: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """Indicators of the tail's rows after ``base``, and the averages after each row."""
    n, close = base[1], base[2]
    fast, slow, signal, gain, loss, reach = base[3:9]
    sizes = dict(zip(SIZES, base[9:]))
    c, h, low = (tail[x].to_numpy(dtype=float) for x in ("close", "high", "low"))
    prev = np.concatenate(([np.nan if close is None else close], c[:-1]))
    step = c - prev
    up, down = np.where(step > 0, step, 0.0), np.where(step < 0, -step, 0.0)
    span = np.fmax(h - low, np.fmax(np.abs(h - prev), np.abs(low - prev)))
    ema_fast, ema_slow = averaged(fast, c, 2 / (sizes["fast"] + 1)), averaged(slow, c, 2 / (sizes["slow"] + 1))
    macd = rounded(rounded(ema_fast, 4) - rounded(ema_slow, 4), 4)
    ema_signal = averaged(signal, macd, 2 / (sizes["signal"] + 1))
    skip = int(n == 0)  # the first row of a symbol has no move
    g, lo = (np.concatenate((np.full(skip, np.nan), averaged(b, x[skip:], 1 / sizes["rsi"]))) for b, x in ((gain, up), (loss, down)))
    tr = averaged(reach, span, 1 / sizes["atr"])
    rows = n + np.arange(1, len(c) + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        index = 1 + np.where(lo > 0, g / lo, np.nan)
        rsi = np.where(rows - 1 >= sizes["rsi"], rounded(100 - 100 / index, 4), np.nan)
    line = rounded(ema_signal, 4)
    out = pd.DataFrame({"date": tail["date"], "ema_12": rounded(ema_fast, 4), "ema_26": rounded(ema_slow, 4), "macd": macd,
                        "macd_signal": line, "macd_hist": rounded(macd - line, 4), "rsi_14": rsi,
                        "atr_14": np.where(rows >= sizes["atr"], rounded(tr, 4), np.nan), "late": False})
    return out, [ema_fast, ema_slow, ema_signal, g, lo, tr]


class IndicatorState(StatefulProcessor):
    """One symbol's base and tail; see the module's text."""

    def __init__(self, tail: int = TAIL):
        self.rows = tail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base, self.tail = handle.getValueState("base", BASE), handle.getListState("tail", BAR)

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        row = initial.iloc[0]
        blank = lambda v: None if v is None or v != v else v
        self.base.update(tuple(blank(row[f"base_{x}"]) for x in ("date", "n", "close", *AVERAGES, *SIZES)))
        self.tail.put([tuple(x) for x in zip(row["tail_date"], row["tail_high"], row["tail_low"], row["tail_close"])])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        base = tuple(self.base.get()) if self.base.exists() else (None, 0, None) + (None,) * len(AVERAGES) + STANDARD
        new = pd.concat(list(rows))[["date", "high", "low", "close"]].drop_duplicates("date", keep="last")
        old = new["date"] <= base[0] if base[0] else pd.Series(False, index=new.index)
        if old.any():
            yield pd.DataFrame({"symbol": key[0], "date": new["date"][old], "late": True}).reindex(columns=_NAMES)
        new = new[~old]
        if not len(new):
            return
        held = pd.DataFrame([tuple(r) for r in self.tail.get()] if self.tail.exists() else [], columns=new.columns)
        tail = pd.concat([held[~held["date"].isin(new["date"])], new]).sort_values("date", ignore_index=True)
        out, averages = run_from(base, tail)
        yield out[out["date"] >= new["date"].min()].assign(symbol=key[0])[_NAMES]
        fold = len(tail) - self.rows
        if fold > 0:
            last = tail.iloc[fold - 1]
            values = [None if v[fold - 1] != v[fold - 1] else float(v[fold - 1]) for v in averages]
            self.base.update((last["date"], base[1] + fold, float(last["close"]), *values, *base[9:]))
            tail = tail.iloc[fold:]
        elif not self.base.exists():
            self.base.update(base)
        self.tail.put(list(tail.itertuples(index=False, name=None)))

    def close(self) -> None:
        pass


_NAMES = [f.split()[0] for f in OUT.split(", ")]


def _levels() -> tuple[list[E.Ewm], list[E.Ewm]]:
    """The averages over columns of a row's own window sizes; the second level reads the first."""
    def spec(out: str, src: str, size: str, is_span: bool) -> E.Ewm:
        n = F.col(size)
        among = [v[_REGIME[size]] for v in cfg.REGIME_WINDOWS.values()]
        ends = [2 / (v + 1) if is_span else 1 / v for v in among]
        return E.Ewm(out, src, F.lit(2.0) / (n + 1) if is_span else F.lit(1.0) / n, 1, None, (min(ends), max(ends)))

    return ([spec("ema_fast", "close", "fast", True), spec("ema_slow", "close", "slow", True), spec("gain", "_gain", "rsi", False),
             spec("loss", "_loss", "rsi", False), spec("range", "_tr", "atr", False)], [spec("ema_signal", "macd", "signal", True)])


def _macd():
    return I.rnd(I.rnd(F.col("ema_fast"), 4) - I.rnd(F.col("ema_slow"), 4), 4)


def _states(rows: DataFrame, tail: int) -> DataFrame:
    """One row per symbol of its rows with averages: the row before the newest ``tail`` ones as base, and those.

    Rows marked ``_seed`` are former bases: they may be the base again, but are no bars of the tail.
    """
    c = F.col
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    own = rows.withColumn("_age", age).where((c("_age") <= tail + 1) | c("_seed"))  # a bounded number of rows per symbol
    at = F.when((c("_age") == tail + 1) | (c("_seed") & (c("_age") <= tail)), F.struct("date", "n", "close", *AVERAGES))
    bars = F.sort_array(F.collect_list(F.when((c("_age") <= tail) & ~c("_seed"), F.struct("date", "high", "low", "close"))))
    g = own.groupBy("symbol").agg(F.max(at).alias("b"), bars.alias("t"), *[F.max(s).alias(f"base_{s}") for s in SIZES])
    return g.select("symbol", *[(F.coalesce(f"b.{x}", F.lit(0)) if x == "n" else c(f"b.{x}")).alias(f"base_{x}")
                                for x in ("date", "n", "close", *AVERAGES)], *[f"base_{s}" for s in SIZES],
                    *[c(f"t.{x}").alias(f"tail_{x}") for x in ("date", "high", "low", "close")])


def initial_state(bars: DataFrame, tail: int = TAIL) -> DataFrame:
    """One row per symbol of stored bars: the averages before its newest ``tail`` rows, those rows, and its window sizes.

    The sizes follow the symbol's volatility regime in the stored bars and stay until the next initial state.
    """
    c = F.col
    m = I.regime_windows(bars)
    sizes = m.select("symbol", c("macd_fast").alias("fast"), c("macd_slow").alias("slow"), c("macd_signal").alias("signal"), "rsi", "atr")
    d = I.moves(bars.select("symbol", "date", "high", "low", "close")).join(sizes, "symbol")
    level1, level2 = _levels()
    d = E.with_ewm(E.number_rows(d, ["symbol"], "date", E.block_rows(level1 + level2)), ["symbol"], level1)
    d = E.with_ewm(d.withColumn("macd", _macd()), ["symbol"], level2)
    return _states(d.select("symbol", "date", "high", "low", "close", *AVERAGES, *SIZES, c("_rn").cast("long").alias("n"),
                            F.lit(False).alias("_seed")), tail)


#: Where a size stands in ``REGIME_WINDOWS``.
_REGIME = {"rsi": 0, "atr": 2, "fast": 3, "slow": 4, "signal": 5}


def indicator_stream(bars: DataFrame, initial: DataFrame | None = None, tail: int = TAIL) -> DataFrame:
    """Updates of (symbol, date): a late or corrected day emits the days after it again.  Bars must be complete."""
    return bars.groupBy("symbol").transformWithStateInPandas(
        IndicatorState(tail), OUT, "Update", "None", initialState=initial.groupBy("symbol") if initial is not None else None)


def run_indicators(bars: DataFrame, base: str, initial: DataFrame | None = None, tail: int = TAIL) -> DataFrame:
    """Drain a finite stream of bars into a day-partitioned indicator table and read it back."""
    spark, path = bars.sparkSession, os.path.join(base, "table")
    if spark.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError(f"{PROVIDER} must be {ROCKSDB}: the state holds a list")
    drain(indicator_stream(bars, initial, tail).writeStream.outputMode("update").option("checkpointLocation", os.path.join(base, "ck"))
          .foreachBatch(upsert_sink(path)).trigger(availableNow=True).start())
    return spark.read.schema(OUT).parquet(path).select(*_NAMES)




# --- all symbols of a batch at once ------------------------------------------------------------------------------------

STATE = ("symbol string, " + ", ".join(f"base_{f}" for f in BASE.split(", ")) + ", tail_date array<date>, tail_high array<double>, "
         "tail_low array<double>, tail_close array<double>")


def arrived(batch: DataFrame, states: DataFrame) -> DataFrame:
    """One row per symbol of the batch: its state, ``_late`` and ``_rows``, the batch's days that its base holds already and the others."""
    c = F.col
    one = batch.groupBy("symbol", "date").agg(F.max(F.struct("high", "low", "close")).alias("_v"))
    days = one.groupBy("symbol").agg(F.collect_list(F.struct("date", "_v.high", "_v.low", "_v.close")).alias("_new"))
    g = days.join(states, "symbol", "left")
    sizes = {f"base_{s}": F.coalesce(f"base_{s}", F.lit(v)) for s, v in zip(SIZES, STANDARD)}  # of a symbol without state
    return g.withColumns({**sizes, "base_n": F.coalesce("base_n", F.lit(0)),
                          "_late": F.filter("_new", lambda r: F.coalesce(r["date"] <= c("base_date"), F.lit(False))),
                          "_rows": F.filter("_new", lambda r: F.coalesce(r["date"] > c("base_date"), F.lit(True)))}).drop("_new")


def continued(own: DataFrame) -> DataFrame:
    """The rows of :func:`arrived` symbols from their base on, put in their places in the tail, with the averages after each.

    The base stands before them as a row of its own, ``_seed``, whose averages are the state's: an exponential average goes on from its
    last value as from a first observation.  ``_from`` is the first changed day.
    """
    c = F.col
    tail = F.transform(F.arrays_zip("tail_date", "tail_high", "tail_low", "tail_close"), lambda x: F.struct(
        x["tail_date"].alias("date"), x["tail_high"].alias("high"), x["tail_low"].alias("low"), x["tail_close"].alias("close")))
    none = F.slice("_rows", 1, 0)
    base = F.struct(c("base_date").alias("date"), *[F.lit(None).cast("double").alias(x) for x in ("high", "low")], c("base_close").alias("close"))
    d = own.where(F.size("_rows") > 0).withColumns({"_days": F.transform("_rows", lambda r: r["date"]), "_tail": F.coalesce(tail, none)})
    held = F.filter("_tail", lambda r: ~F.array_contains("_days", r["date"]))
    seed = F.when(c("base_date").isNotNull(), F.array(base)).otherwise(none)
    d = d.select("symbol", F.array_min("_days").alias("_from"), "base_date", "base_n", *[c(f"base_{a}") for a in AVERAGES],
                 *[c(f"base_{s}").alias(s) for s in SIZES], F.inline(F.concat(seed, held, "_rows")))
    d = I.moves(d.withColumn("_seed", F.coalesce(c("date") == c("base_date"), F.lit(False))))
    level1, level2 = _levels()
    d = E.number_rows(d, ["symbol"], "date", E.block_rows(level1 + level2))
    for level in (level1, level2):
        if level is level2:
            d = d.withColumn("macd", _macd())
        d = d.withColumns({f"_in_{s.out}": F.when(c("_seed"), c(f"base_{s.out}")).otherwise(c(s.src)) for s in level})
        d = E.with_ewm(d, ["symbol"], [replace(s, src=f"_in_{s.out}") for s in level])
    n = c("base_n") + c("_rn") - F.when(c("base_date").isNull(), 0).otherwise(1)
    return d.select("symbol", "date", "high", "low", "close", "macd", *AVERAGES, *SIZES, n.alias("n"), "_seed", "_from")


def changed_rows(rows: DataFrame, own: DataFrame) -> DataFrame:
    """What a batch emits: every row from a symbol's first changed one on, and the days that are older than its base as ``late``."""
    c = F.col
    line = I.rnd(c("ema_signal"), 4)
    rsi = I.rnd(100 - div(F.lit(100.0), 1 + div(c("gain"), c("loss"))), 4)
    out = rows.where(~c("_seed") & (c("date") >= c("_from"))).select(
        "symbol", "date", I.rnd(c("ema_fast"), 4).alias("ema_12"), I.rnd(c("ema_slow"), 4).alias("ema_26"), "macd", line.alias("macd_signal"),
        I.rnd(c("macd") - line, 4).alias("macd_hist"), F.when(c("n") > c("rsi"), rsi).alias("rsi_14"),
        F.when(c("n") >= c("atr"), I.rnd(c("range"), 4)).alias("atr_14"), F.lit(False).alias("late"))
    late = own.select("symbol", F.explode("_late.date").alias("date"))
    return out.unionByName(late.withColumn("late", F.lit(True)), allowMissingColumns=True)


def indicator_sink(base: str, tail: int = TAIL, every: int = 16):
    """``foreachBatch`` writer of indicators; version 0 of the states is the initial one, and batch k leaves version k + 1.

    A batch written twice starts from the same version and leaves the same rows and states.
    """
    states = Versioned(os.path.join(base, "states"), STATE, ("symbol",), every)
    merge = upsert_sink(os.path.join(base, "table"))

    def write(batch: DataFrame, batch_id: int) -> None:
        # Both are read by the rows, the days' merge and the new states; a lost part is computed again.
        own = arrived(batch, states.before(batch.sparkSession, batch_id + 1)).persist()
        rows = continued(own).persist()
        merge(changed_rows(rows, own), batch_id)
        states.write(_states(rows, tail), batch_id + 1)
        rows.unpersist()
        own.unpersist()

    return write


def run_indicators_by_batch(bars: DataFrame, base: str, initial: DataFrame | None = None, tail: int = TAIL, every: int = 16) -> DataFrame:
    """:func:`run_indicators` for batches that touch many symbols; ``initial`` counts when the first run starts, later ones go on."""
    spark, first = bars.sparkSession, Versioned(os.path.join(base, "states"), STATE, ("symbol",), every)
    if not exists(spark, os.path.join(first.folder(0), "_SUCCESS")):
        first.write(spark.createDataFrame([], STATE) if initial is None else initial, 0)
    drain(bars.writeStream.option("checkpointLocation", os.path.join(base, "ck")).foreachBatch(indicator_sink(base, tail, every))
          .trigger(availableNow=True).start())
    return spark.read.schema(OUT).parquet(os.path.join(base, "table")).select(*_NAMES)
