"""Daily aggregates kept as mergeable moments: a batch adds its rows to the days it touches, and no day is aggregated again.

A day is (count, mean, second to fourth central sums, counts of signs, extremes with their symbols).  Two such records merge by the
pairwise update, in any order and grouping, so rows may come days late and in any number of batches; every price row must come once
(:mod:`tickloom.streaming.exact` removes repeats before).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.numeric import div
from tickloom.operators import daily as D
from tickloom.streaming.runtime import drain
from tickloom.streaming.versioned import Versioned, rows_of_keys

KEY = ("universe", "date")
SCHEMA = ("universe string, date date, n long, mean double, m2 double, m3 double, m4 double, n_gainers long, n_losers long, n_flat long, "
          "best_pct double, best_stock string, worst_pct double, worst_stock string")


def day_moments(prices: DataFrame) -> DataFrame:
    """One record per (universe, date), from one hash aggregate and the rows at a day's extremes."""
    n, c = F.col("n"), F.col
    g = D.cross_section(prices)
    var = F.coalesce(c("_var"), F.lit(0.0))
    # The population skewness and kurtosis of a constant group are NaN; its central sums are 0.
    third = F.when(var > 0, c("_g1") * F.pow(var, 1.5) * n).otherwise(0.0)
    fourth = F.when(var > 0, (c("_g2") + 3) * var * var * n).otherwise(0.0)
    return g.withColumn("n", c("_n")).select(
        *KEY, "n", F.coalesce("_avg", F.lit(0.0)).alias("mean"), (var * n).alias("m2"), third.alias("m3"), fourth.alias("m4"), "n_gainers",
        "n_losers", "n_flat", "best_pct", "best_stock", "worst_pct", "worst_stock")


def merged(a: str, b: str) -> list[Column]:
    """The columns of the record that holds the rows of both structs ``a`` and ``b``, either of which may be NULL."""
    def get(name: str, zero=0) -> tuple[Column, Column]:
        return F.coalesce(F.col(f"{a}.{name}"), F.lit(zero)), F.coalesce(F.col(f"{b}.{name}"), F.lit(zero))

    na, nb = (x.cast("double") for x in get("n"))
    (ma, mb), (va, vb), (sa, sb), (ka, kb) = (get(x, 0.0) for x in ("mean", "m2", "m3", "m4"))
    n, d = na + nb, mb - ma
    e = F.when(n > 0, d / n).otherwise(0.0)  # d / n

    def extreme(pct: str, who: str, better) -> list[Column]:
        pa, pb, wa, wb = (F.col(f"{s}.{x}") for x in (pct, who) for s in (a, b))
        name = F.when(pa == pb, F.least(wa, wb)).when(pb.isNull() | better(pa, pb), wa).otherwise(wb)
        value = F.greatest(pa, pb) if better is _more else F.least(pa, pb)
        return [value.alias(pct), name.alias(who)]

    return [
        n.cast("long").alias("n"), (ma + e * nb).alias("mean"), (va + vb + d * e * na * nb).alias("m2"),
        (sa + sb + d * e * e * na * nb * (na - nb) + 3 * e * (na * vb - nb * va)).alias("m3"),
        (ka + kb + d * e * e * e * na * nb * (na * na - na * nb + nb * nb) + 6 * e * e * (na * na * vb + nb * nb * va)
         + 4 * e * (na * sb - nb * sa)).alias("m4"),
        *[(get(x)[0] + get(x)[1]).alias(x) for x in ("n_gainers", "n_losers", "n_flat")],
        *extreme("best_pct", "best_stock", _more), *extreme("worst_pct", "worst_stock", _less)]


def _more(x: Column, y: Column) -> Column:
    return x > y


def _less(x: Column, y: Column) -> Column:
    return x < y


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The records of both tables, those of one key merged; each table has a key once."""
    values = [c for c in new.columns if c not in KEY]
    a = old.select(*KEY, F.struct(*values).alias("_a"))
    b = new.select(*KEY, F.struct(*values).alias("_b"))
    return a.join(b, list(KEY), "full").select(*KEY, *merged("_a", "_b"))


def daily_from_moments(days: DataFrame) -> DataFrame:
    """The market table of :func:`tickloom.operators.daily.daily_breadth` from merged records."""
    n, c = F.col("n").cast("double"), F.col
    var = c("m2") / n
    g = days.select(
        *KEY, "n_gainers", "n_losers", "n_flat", F.when(n > 0, c("mean")).alias("_avg"),
        F.when(n > 1, F.sqrt(c("m2") / (n - 1))).alias("_sd"), div(c("m3") / n, F.pow(var, 1.5)).alias("_g1"),
        (div(c("m4") / n, var * var) - 3).alias("_g2"), c("n").alias("_n"), "best_stock", "best_pct", "worst_stock", "worst_pct")
    return D.described(g)


def moment_sink(table: Versioned):
    """``foreachBatch`` writer that merges a batch of price rows into its days' records."""
    def write(batch: DataFrame, batch_id: int) -> None:
        new = day_moments(batch)
        old = rows_of_keys(table.before(batch.sparkSession, batch_id), new, KEY)
        table.write(merge(old, new), batch_id)

    return write


def run_daily(prices: DataFrame, base: str, every: int = 16) -> DataFrame:
    """Drain a finite stream of price rows into day records and read the market table they give."""
    table, last = Versioned(os.path.join(base, "days"), SCHEMA, KEY, every), []
    write = moment_sink(table)

    def sink(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        last.append(batch_id)

    drain(prices.writeStream.option("checkpointLocation", os.path.join(base, "ck")).foreachBatch(sink).trigger(availableNow=True).start())
    return daily_from_moments(table.before(prices.sparkSession, last[-1] + 1 if last else 0))
