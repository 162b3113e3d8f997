"""Exact ranks and quantiles of groups too large for one task.

A window ordered by value, or ``percentile``, puts a whole group in one task.  Here equal values are first merged map-side, each group's
value range is cut into bins of about ``BIN_ROWS`` distinct values, and ordering happens only inside one (group, bin).  A bin's position in
the group comes from a running sum over the bin totals, so both the number of bins and the number of totals grow with the group.

The cuts come from a sample by a hash of the value, ``OVER`` values a bin, so a task that is recomputed after an executor is lost sees the
same cuts; a mergeable random sketch would not give that.  Any cuts give exact results; good cuts only balance the bins.

Ranks are attached to rows without a join on the value (:func:`attach_ranks`): a row finds its bin among its group's cuts, and values that
very many rows share are a small sorted list per group, so they never meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BIN_ROWS, OVER = 8192, 8
#: A value is heavy when more rows share it than this, and than a ``HEAVY_PART``-th of its group; so many parts do heavy rows take.
HEAVY_ROWS, HEAVY_PART = 1024, 4096
_STEP = 64
_BUCKETS = 1 << 30


def value_counts(df: DataFrame, keys: Sequence[str], value: str, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows per distinct value of each group; ``extra`` names further aggregates over a value's rows."""
    more = [v.alias(k) for k, v in (extra or {}).items()]
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *more)


def _coarse(ordered: str) -> Column:
    """Every ``_STEP``-th entry of a sorted array."""
    return F.filter(ordered, lambda v, i: i % _STEP == _STEP - 1)


def _under(ordered: Column, coarse: Column, v: Column) -> Column:
    """How many entries of a sorted array lie under ``v``: first among every ``_STEP``-th, then inside one stretch."""
    jump = F.size(F.filter(coarse, lambda x: x < v)) * _STEP
    return jump + F.size(F.filter(F.slice(ordered, jump + 1, _STEP), lambda x: x < v))


def _cuts(vc: DataFrame, keys: list[str], value: str, bin_rows: int) -> DataFrame:
    """(keys, _cuts, _coarse) of the groups with more than one bin."""
    # Looking at ``n`` keeps the counts in these branches too, so all branches read one and the same shuffle.
    size = vc.groupBy(*keys).agg(F.count_if(F.col("n") > 0).alias("_d")).where(F.col("_d") > bin_rows)
    draw = F.pmod(F.xxhash64(value), F.lit(_BUCKETS))
    drawn = vc.where("n > 0").join(size, keys).where(draw * F.col("_d") < F.lit(_BUCKETS * OVER) * F.ceil(F.col("_d") / bin_rows))
    every = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_s"))
    return every.select(*keys, F.filter("_s", lambda v, i: i % OVER == OVER - 1).alias("_cuts")).withColumn("_coarse", _coarse("_cuts"))


def _binned(df: DataFrame, cuts: DataFrame, keys: list[str], value: str) -> DataFrame:
    bin_ = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(_under(F.col("_cuts"), F.col("_coarse"), F.col(value)))
    return df.join(cuts, keys, "left").withColumn("_bin", bin_).drop("_cuts", "_coarse")


def _offsets(binned: DataFrame, keys: list[str]) -> DataFrame:
    totals = binned.groupBy(*keys, "_bin").agg(F.sum("n").alias("_bin_n"))
    before = F.sum("_bin_n").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(*keys, "_bin", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_bin_n").over(Window.partitionBy(*keys)).alias("total"))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, bin_rows: int = BIN_ROWS,
                  extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per distinct (keys, value): ``n`` copies, ``below`` rows under it, ``total`` rows in the group, and the ``extra`` sums."""
    if not keys:
        return ranked_values(df.withColumn("_all", F.lit(0)), ["_all"], value, bin_rows, extra).drop("_all")
    keys, more = list(keys), list(extra or {})
    vc = value_counts(df, keys, value, extra)
    binned = _binned(vc, _cuts(vc, keys, value, bin_rows), keys, value)
    in_bin = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        binned.withColumn("_within", F.coalesce(F.sum("n").over(in_bin), F.lit(0))).join(_offsets(binned, keys), [*keys, "_bin"])
        .select(*keys, value, "n", (F.col("_before") + F.col("_within")).alias("below"), "total", *more)
    )


def average_rank() -> Column:
    """1-based average-tie rank of a :func:`ranked_values` row."""
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)


def attach_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, bin_rows: int = BIN_ROWS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``df`` with the average-tie rank of ``value`` in its group, NULL where the value is.

    A group's cuts, the rows before each of its bins, and its heavy values with their ranks are one row per group, joined on the group
    alone.  A heavy value's rows read their rank from the list; the others are ranked by a window inside their bin, which no single value
    dominates.
    """
    keys, c = list(keys), F.col
    vc = value_counts(df, keys, value)
    cuts = _cuts(vc, keys, value, bin_rows)
    # One row per group, by way of one per bin: the rows before each bin, and the heavy values with what lies before them in their bin.
    under = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = F.when(c("n") > heavy_rows, F.struct(c(value).alias("v"), c("n"), under.alias("under")))
    bins = _binned(vc, cuts, keys, value).select(*keys, "_bin", "n", many.alias("_many")).groupBy(*keys, "_bin").agg(
        F.sum("n").alias("n"), F.collect_list("_many").alias("many"))
    group = bins.groupBy(*keys).agg(F.sum("n").alias("_total"), F.sort_array(F.collect_list(F.struct(c("_bin").alias("bin"), "n", "many"))).alias("_b"))
    before = F.transform("_b", lambda b, i: F.struct(b["bin"].alias("bin"), F.aggregate(
        F.slice("_b", F.lit(1), i), F.lit(0).cast("long"), lambda a, e: a + e["n"]).alias("before"), b["many"].alias("many")))
    group = group.select(*keys, "_total", before.alias("_b"))
    heavy = F.flatten(F.transform("_b", lambda b: F.transform(
        F.filter(b["many"], lambda h: h["n"] * HEAVY_PART > c("_total")), lambda h: F.struct(
            h["v"].alias("v"), (b["before"] + h["under"] + (h["n"] + 1) / F.lit(2.0)).alias("rank"), h["n"].alias("n"), b["bin"].alias("bin")))))
    group = group.select(*keys, F.map_from_entries(F.transform("_b", lambda b: F.struct(b["bin"], b["before"]))).alias("_starts"),
                         F.sort_array(heavy).alias("_h")).join(cuts, keys, "left")

    v = c(value)
    d = df.join(group, keys, "left")
    bin_ = F.when(c("_cuts").isNull(), F.lit(0)).otherwise(_under(c("_cuts"), c("_coarse"), v))
    own = F.filter("_h", lambda h: h["v"] == v)
    d = d.withColumns({"_bin": bin_, "_own": F.get(own, F.lit(0))["rank"]})
    heavier = F.aggregate(F.filter("_h", lambda h: (h["bin"] == c("_bin")) & (h["v"] < v)), F.lit(0).cast("long"), lambda a, h: a + h["n"])
    # Heavy rows and rows without a value are not ranked here: they are dealt over many parts by a hash of the row.
    spare = -1 - F.pmod(F.xxhash64(*df.columns), F.lit(HEAVY_PART)).cast("int")
    part = F.when(v.isNotNull() & c("_own").isNull(), c("_bin")).otherwise(spare)
    d = d.select(*df.columns, "_own", (F.element_at("_starts", c("_bin")) + heavier).alias("_start"), part.alias("_part"))
    w = Window.partitionBy(*keys, "_part").orderBy(value)
    upto = F.count(value).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.coalesce("_own", c("_start") + (F.rank().over(w) + upto) / F.lit(2.0))
    return d.select(*df.columns, F.when(v.isNotNull(), rank).alias(out))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], prefix: str = "q",
              bin_rows: int = BIN_ROWS) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column ``{prefix}{i}`` per probability."""
    keys = list(keys)
    rv = ranked_values(df, keys, value, bin_rows)
    v, lo_pos = F.col(value), F.col("below")
    hi_pos = F.col("below") + F.col("n") - 1
    aggs = [F.max("total").alias("_total")]
    for i, p in enumerate(probs):
        pos = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [F.max(F.when((lo_pos <= lo) & (lo <= hi_pos), v)).alias(f"_lo{i}"),
                 F.max(F.when((lo_pos <= hi) & (hi <= hi_pos), v)).alias(f"_hi{i}")]
    out = rv.groupBy(*keys).agg(*aggs)
    cols = []
    for i, p in enumerate(probs):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(f"{prefix}{i}"))
    return out.select(*keys, *cols)
