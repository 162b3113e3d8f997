"""Indicators after a late or corrected bar, from snapshots instead of a run over the whole series.

Bars are stored by block of time.  A snapshot per (symbol, block) holds what the indicators of later rows need from all rows up to the
block's end: for every exponential average its value, its number of observations and the date of the last one; the newest ``TAIL`` bars,
which the trailing windows reach back into; and the block's share of the volatility distribution that decides the symbol's window sizes.
A changed day then reruns from the snapshot before its block: only blocks from that one on are read.

An average goes on from a snapshot as from a first observation: the frame that is run is the tail and the later bars, with the average's
value standing at the date of its last observation and nothing before it.  That is exact, for an exponential average is its first value
decayed plus what came after.

Window sizes follow a symbol's volatility regime over its whole series.  Where a change moves a symbol to another regime, all its rows
change, and that symbol alone is run from its first bar.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom import config as cfg
from tickloom.functions import windows as W
from tickloom.functions.numeric import div
from tickloom.operators import ewm as E, indicators as I

SYM = ["symbol"]
#: Rows that the longest trailing window reaches back, and one more for its first return.
TAIL = cfg.DRAWDOWN_WINDOW + 1
BAR = ("date", "open", "high", "low", "close", "volume")
c = F.col


def yearly(date: Column) -> Column:
    """The default block of a date: its year."""
    return F.year(date)


def _sources() -> dict[str, str]:
    return {s.out: s.src for level in I.levels() for s in level}


def _seeded(df: DataFrame, specs: list[E.Ewm]) -> tuple[DataFrame, list[E.Ewm]]:
    """The averages' inputs: the snapshot's value at its date inside the tail, the real input after it."""
    def source(s: E.Ewm) -> Column:
        seed = F.when(c("date") == c(f"_seed.{s.out}.at"), c(f"_seed.{s.out}.y"))
        return F.when(c("_tail"), seed).otherwise(c(s.src))

    out = df.withColumns({f"_in_{s.out}": source(s) for s in specs})
    return out, [replace(s, src=f"_in_{s.out}", min_rows=1, digits=None, out=f"_y_{s.out}", skip=0) for s in specs]


def _counted(df: DataFrame, specs: list[E.Ewm]) -> DataFrame:
    """After the averages ``_y_*``: their observations so far, the last one's date, and the averages as the suite publishes them."""
    seen = W.up_to(SYM)
    here = {s.out: F.when(~c("_tail") & c(s.src).isNotNull(), c("date")) for s in specs}
    df = df.withColumns({
        **{f"_n_{o}": F.coalesce(c(f"_seed.{o}.n"), F.lit(0)) + F.count(d).over(seen) for o, d in here.items()},
        **{f"_at_{o}": F.coalesce(F.max(d).over(seen), c(f"_seed.{o}.at")) for o, d in here.items()}})

    def shown(s: E.Ewm) -> Column:
        y = F.when(c(f"_n_{s.out}") >= s.min_rows, c(f"_y_{s.out}"))
        return y if s.digits is None else I.rnd(y, s.digits)

    return df.withColumns({s.out: shown(s) for s in specs})


def _run(frame: DataFrame) -> DataFrame:
    """The suite over a frame of tail and later rows, with the averages' state beside it.

    ``frame``: the bars, block, vol_regime_mult, and _tail (row of the tail), _r14 (its plain RSI), _seed (the symbol's averages).
    """
    level1, level2 = I.levels()
    d = I.moves(I.windowed(frame.withColumnRenamed("_r14", "_old_r14")))
    keep = [x for x in d.columns if x not in ("_gain", "_loss", "_tr", "_pdm", "_mdm")]
    state = [f"_{k}_{s.out}" for s in level1 for k in ("y", "n", "at")]
    d = E.number_rows(d, SYM, "date", E.block_rows(level1 + level2))
    d, specs = _seeded(d, level1)
    d = _counted(E.with_ewm(d, SYM, specs), level1)
    d = I.from_first_level(d, [*keep, "_rn", "_blk", "_i", *state])
    d, specs = _seeded(d, level2)
    d = _counted(E.with_ewm(d, SYM, specs), level2)
    d = d.withColumn("_r14", F.when(c("_tail"), c("_old_r14")).otherwise(c("_r14"))).withColumn("_own_r14", c("_r14"))
    return I.from_second_level(d).withColumnRenamed("_own_r14", "_r14")


def _state() -> Column:
    return F.struct(*[F.struct(c(f"_y_{o}").alias("y"), c(f"_n_{o}").alias("n"), c(f"_at_{o}").alias("at")).alias(o) for o in _sources()])


def _deviations(frame: DataFrame) -> DataFrame:
    """Per row the return and the deviation of the last quarter's returns; both NULL where the frame does not reach back far enough."""
    wo, q = W.ordered(SYM), cfg.ADAPTIVE_LOOKBACK
    prev = F.lag("close").over(wo)
    d = frame.withColumn("_ret", div(c("close") - prev, prev))
    w = W.trailing(SYM, q)
    return d.withColumn("_hist", F.when(F.count("_ret").over(w) >= q, F.stddev_samp("_ret").over(w)))


def _multipliers(frame: DataFrame, earlier: DataFrame) -> DataFrame:
    """(symbol, mult) of the whole series: deviations of the frame's later rows and those that ``earlier`` snapshots hold."""
    q = cfg.ADAPTIVE_LOOKBACK
    d = _deviations(frame)
    newest = F.row_number().over(Window.partitionBy(*SYM).orderBy(F.col("_ret").isNull(), F.desc("date")))
    d = d.withColumn("_age", newest)
    later = ~c("_tail")
    g = d.groupBy("symbol").agg(
        F.stddev_samp(F.when((c("_age") <= cfg.ADAPTIVE_RECENT) & c("_ret").isNotNull(), c("_ret"))).alias("_recent"),
        F.count(F.when(later, c("_ret"))).alias("_n"), F.collect_list(F.when(later, c("_hist"))).alias("_hist"))
    old = earlier.groupBy("symbol").agg(F.sum("n_returns").alias("_n0"), F.flatten(F.collect_list("hist")).alias("_hist0"))
    g = g.join(old, "symbol", "left")
    every = F.concat("_hist", F.coalesce("_hist0", F.array().cast("array<double>")))
    n = c("_n") + F.coalesce("_n0", F.lit(0))
    rank = div(F.size(F.filter(every, lambda h: h < c("_recent"))), F.size(every))
    mult = (F.when(n < q, F.lit(1.0)).when(rank >= cfg.ADAPTIVE_HIGH, F.lit(cfg.ADAPTIVE_FAST_MULT))
            .when(rank <= cfg.ADAPTIVE_LOW, F.lit(cfg.ADAPTIVE_SLOW_MULT)).otherwise(F.lit(1.0)))
    return g.select("symbol", mult.alias("vol_regime_mult"))


def snapshots(run: DataFrame) -> DataFrame:
    """One row per (symbol, block) of the later rows of a :func:`_run`: the averages at its end, the tail, deviations, window multiplier."""
    d = _deviations(run)
    own = d.where(~c("_tail")).groupBy("symbol", "block").agg(
        F.max(F.struct("date", _state().alias("seed"))).alias("_last"), F.max("vol_regime_mult").alias("mult"),
        F.count("_ret").alias("n_returns"), F.collect_list("_hist").alias("hist"),
        F.sort_array(F.collect_list(F.struct(*BAR, "_r14"))).alias("_rows"))
    before = d.where("_tail").groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(*BAR, "_r14"))).alias("_tail0"))
    # A block has a row at least, so TAIL blocks hold the tail.
    w = Window.partitionBy(*SYM).orderBy("block").rowsBetween(-TAIL, 0)
    rows = F.concat(F.coalesce("_tail0", F.slice("_rows", 1, 0)), F.flatten(F.collect_list("_rows").over(w)))
    d = own.join(before, "symbol", "left").select("symbol", "block", "mult", "n_returns", "hist", c("_last.seed").alias("seed"), rows.alias("_all"))
    return d.withColumn("tail", F.slice("_all", F.greatest(F.size("_all") - TAIL + 1, F.lit(1)), TAIL)).drop("_all")


def _frame(later: DataFrame, snap: DataFrame) -> DataFrame:
    """The tail rows of one snapshot per symbol and the later bars, each with the symbol's averages."""
    seed = snap.select("symbol", c("seed").alias("_seed"))
    bars = later.select("symbol", "block", *BAR).withColumns({"_tail": F.lit(False), "_r14": F.lit(None).cast("double")}).join(seed, "symbol", "left")
    tail = snap.select("symbol", "block", c("seed").alias("_seed"), F.inline("tail")).withColumn("_tail", F.lit(True))
    return bars.unionByName(tail.select(*bars.columns))


def full_run(bars: DataFrame, block=yearly, keep: Callable[[DataFrame], DataFrame] = lambda run: run) -> tuple[DataFrame, DataFrame]:
    """(indicators, snapshots) of whole series: what is stored before anything changes.

    Both follow from one run; ``keep`` may write it down and read it back, so that it is computed once.
    """
    later = bars.select("symbol", *BAR, block(c("date")).alias("block"))
    one = F.struct(F.lit(None).cast("double").alias("y"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("date").alias("at"))
    frame = later.withColumns({"_tail": F.lit(False), "_r14": F.lit(None).cast("double"), "_seed": F.struct(*[one.alias(o) for o in _sources()])})
    run = keep(_run(I.with_multiplier(frame)))
    return published(run), snapshots(run)


def published(run: DataFrame) -> DataFrame:
    """The later rows of a run as the suite has them."""
    hidden = [x for x in run.columns if x.startswith("_")]
    return run.where(~c("_tail")).drop(*hidden)


def rerun(bars: DataFrame, snaps: DataFrame, changed: DataFrame, block=yearly) -> tuple[DataFrame, DataFrame]:
    """(indicators, snapshots) of the blocks that ``changed`` (symbol, date) touches and all later ones of its symbols.

    ``bars`` is the table as it is now, partitioned by ``block``.  One number goes to the driver: the first block that has to be read.
    A symbol without an earlier snapshot runs from its first bar; one whose regime changed comes back with all its blocks.
    """
    start = changed.groupBy("symbol").agg(F.min(block(c("date"))).alias("_from"))
    first = start.agg(F.min("_from")).first()[0]
    if first is None:
        return published(full_run(bars.limit(0), block)[0].withColumn("_tail", F.lit(False))), snaps.limit(0)
    mine = snaps.join(start, "symbol").where(c("block") < c("_from"))
    newest = F.row_number().over(Window.partitionBy(*SYM).orderBy(F.desc("block")))
    snap = mine.withColumn("_new", newest).where("_new = 1").drop("_new", "_from")
    later = bars.where(c("block") >= first).join(start, "symbol").where(c("block") >= c("_from")).drop("_from")
    frame = _frame(later, snap)
    mult = _multipliers(frame, mine.drop("_from"))
    moved = mult.join(snap.select("symbol", "mult"), "symbol").where(c("mult") != c("vol_regime_mult")).select("symbol")
    run = _run(frame.join(mult, "symbol"))
    indicators, states = published(run), snapshots(run)
    if moved.isEmpty():
        return indicators, states
    whole, whole_states = full_run(bars.join(moved, "symbol", "left_semi"), block)
    return (indicators.join(moved, "symbol", "left_anti").unionByName(whole.select(*indicators.columns)),
            states.join(moved, "symbol", "left_anti").unionByName(whole_states.select(*states.columns)))
