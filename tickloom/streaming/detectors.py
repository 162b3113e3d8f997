"""Live detection against baselines that move with the stream.

Per symbol (count, mean and second central sum of its changes) and per universe (count and sum of daily deviations) the history so far is
a versioned table.  A batch reads the version before it, adds what its own earlier days contribute, judges its rows with the same
detectors as the all-dates run, and writes the next version.  A day must arrive whole, days of a symbol in order; rows that are not newer
than their symbol's last day are kept apart in ``late`` and neither judged nor added.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, functions as F

from tickloom import config as cfg
from tickloom.functions import windows as W
from tickloom.functions.numeric import rnd
from tickloom.operators import anomalies as N, signals as G
from tickloom.streaming.runtime import drain
from tickloom.streaming.versioned import Versioned

SYMBOLS = "symbol string, last date, n long, mean double, m2 double"
MARKET = "universe string, days long, total double"
OUT = "detector string, symbol string, date date, grade string, size double, score double, reason string"
c = F.col


def _joined(n0: Column, mean0: Column, m0: Column, n1: Column, mean1: Column, m1: Column) -> list[Column]:
    """Count, mean and second central sum of two sets of values, either of which may be missing."""
    n0, n1 = F.coalesce(n0, F.lit(0)), F.coalesce(n1, F.lit(0))
    mean0, mean1, m0, m1 = (F.coalesce(x, F.lit(0.0)) for x in (mean0, mean1, m0, m1))
    n, d = n0 + n1, mean1 - mean0
    part = F.when(n > 0, n1 / n).otherwise(0.0)
    return [n, mean0 + d * part, m0 + m1 + d * d * part * n0]


def live_enrich(batch: DataFrame, market: DataFrame) -> DataFrame:
    """The rows of a batch with the columns that the detectors read, from the stored baselines and the batch's earlier days.

    A row carries its symbol's stored baseline as ``_sn``, ``_smean`` and ``_sm2``.
    """
    past, pct, days = W.before(["symbol"]), c("pct_change"), W.before(["universe"])
    own = batch.select("*", F.count(pct).over(past).alias("_n"), F.avg(pct).over(past).alias("_mean"),
                       (F.var_pop(pct).over(past) * F.count(pct).over(past)).alias("_m2"))
    n, mean, m2 = _joined(c("_sn"), c("_smean"), c("_sm2"), c("_n"), c("_mean"), c("_m2"))
    rows = own.select("universe", "symbol", "date", "pct_change", n.alias("hist_n"), F.when(n > 0, mean).alias("hist_mean"),
                      F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("hist_std"))
    g = batch.groupBy("universe", "date").agg(F.stddev_samp(pct).alias("mkt_std"))
    size = rnd(c("mkt_std"), 6)
    before = market.select("universe", c("days").alias("_d"), c("total").alias("_t"))
    total = F.coalesce("_t", F.lit(0.0)) + F.coalesce(F.sum(size).over(days), F.lit(0.0))
    count = F.coalesce("_d", F.lit(0)) + F.count(size).over(days)
    g = g.join(before, "universe", "left").select("universe", "date", "mkt_std", F.when(count > 0, total / count).alias("_b"))
    base = F.coalesce(F.when(c("_b") != 0, c("_b")), F.lit(cfg.BASELINE_VOL_DEFAULT))
    return rows.join(g.withColumn("baseline_vol", base).drop("_b"), ["universe", "date"])


def judge(enriched: DataFrame) -> DataFrame:
    """The rows that the volatility, unusual-move and price-gap detectors report, in one shape and one pass."""
    fired = []
    for kind in ("volatility_spike", "unusual_mover"):
        hit, row = G.DETECTORS[kind]()
        fired.append(F.when(hit, F.struct(F.lit(kind).alias("detector"), *[row[a].alias(b) for a, b in (
            ("symbol", "symbol"), ("date", "date"), ("direction", "grade"), ("strength", "size"), ("score", "score"), ("reason", "reason"))])))
    hit, row = N.gap()
    fired.append(F.when(hit, F.struct(*[row[a].alias(b) for a, b in (
        ("anomaly_type", "detector"), ("symbol", "symbol"), ("date", "date"), ("severity", "grade"), ("z_score", "size"), ("value", "score"),
        ("reason", "reason"))])))
    return enriched.select(F.inline(F.array_compact(F.array(*fired))))


def live_sink(base: str, every: int = 16):
    """``foreachBatch`` writer of what the detectors report; a batch written twice gives the same reports and baselines."""
    symbols = Versioned(os.path.join(base, "symbols"), SYMBOLS, ("symbol",), every)
    market = Versioned(os.path.join(base, "market"), MARKET, ("universe",), every)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known, past = symbols.before(spark, batch_id), market.before(spark, batch_id)
        stored = known.select("symbol", "last", *[c(x).alias(f"_s{x}") for x in ("n", "mean", "m2")])
        # Four writes read the batch's rows with their symbols' baselines; a lost part is read from the source again.
        marked = batch.join(stored, "symbol", "left").persist()
        in_time = F.coalesce(c("date") > c("last"), F.lit(True))
        marked.where(~in_time).select(*batch.columns).write.mode("overwrite").parquet(os.path.join(base, "late", f"batch={batch_id}"))
        rows = marked.where(in_time)
        judge(live_enrich(rows, past)).write.mode("overwrite").parquet(os.path.join(base, "out", f"batch={batch_id}"))
        new = rows.groupBy("symbol").agg(F.max("date").alias("_last"), F.count("pct_change").alias("_n"), F.avg("pct_change").alias("_mean"),
                                         (F.var_pop("pct_change") * F.count("pct_change")).alias("_m2"),
                                         *[F.max(f"_s{x}").alias(f"_s{x}") for x in ("n", "mean", "m2")])
        n, mean, m2 = _joined(c("_sn"), c("_smean"), c("_sm2"), c("_n"), c("_mean"), c("_m2"))
        symbols.write(new.select("symbol", c("_last").alias("last"), n.alias("n"), mean.alias("mean"), m2.alias("m2")), batch_id)
        days = rows.groupBy("universe", "date").agg(rnd(F.stddev_samp("pct_change"), 6).alias("_sd")).groupBy("universe").agg(
            F.count("_sd").alias("_days"), F.coalesce(F.sum("_sd"), F.lit(0.0)).alias("_total"))
        market.write(days.join(past, "universe", "left").select(
            "universe", (F.coalesce("days", F.lit(0)) + c("_days")).alias("days"),
            (F.coalesce("total", F.lit(0.0)) + c("_total")).alias("total")), batch_id)
        marked.unpersist()

    return write


def run_live(prices: DataFrame, base: str, every: int = 16) -> DataFrame:
    """Drain a finite stream of (universe, symbol, date, pct_change) and read the reports back."""
    drain(prices.writeStream.option("checkpointLocation", os.path.join(base, "ck")).foreachBatch(live_sink(base, every))
          .trigger(availableNow=True).start())
    return prices.sparkSession.read.schema(OUT).parquet(os.path.join(base, "out")).drop("batch")
