"""Exponential weighting as window sums.

``y_t = (1-a) y_{t-1} + a x_t`` is a recursion, but its solution is a running sum
of ``a x_s q^-s`` scaled by ``q^t`` (q = 1-a).  The running sum is an ordinary
window aggregate, so recursive indicators stay in the JVM, share the symbol's
sort with the other windows, and need no per-group Python call.

``q^-s`` overflows on a long series, so rows are cut into blocks short enough to
stay finite.  Each block's last value and decay are folded over the earlier
blocks (a handful per symbol), so a row inherits the exact value of all rows
before its block, whatever the block size and however sparse the series.

A missing value keeps the average where it is and lets the old weight decay one
step per row: after ``k`` rows the new value gets ``a / (q^k + a)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.numeric import rnd

FINITE = 600.0  # exp(600) is far from overflow


@dataclass(frozen=True)
class Ewm:
    """One weighted column; ``alpha`` is a number or one value per row with the given range."""

    out: str
    src: str
    alpha: float | Column
    min_rows: int | Column = 1
    digits: int | None = 4
    alpha_range: tuple[float, float] | None = None
    skip: int = 0  # leading rows known to have no value; used when the rest is known to be complete

    def limits(self) -> tuple[float, float]:
        return self.alpha_range or (self.alpha, self.alpha)


def span(out: str, src: str, rows: int, digits: int | None = 4) -> Ewm:
    return Ewm(out, src, 2.0 / (rows + 1), 1, digits)


def wilder(out: str, src: str, rows: int, digits: int | None = None, skip: int = 0) -> Ewm:
    return Ewm(out, src, 1.0 / rows, rows, digits, skip=skip)


def by_regime(out: str, src: str, mult: Column, rows: dict[float, int], is_span: bool, digits: int | None,
              skip: int = 0) -> Ewm:
    """A window size per volatility multiplier."""
    def alpha(n):
        return 2.0 / (n + 1) if is_span else 1.0 / n

    a, m = F.lit(alpha(rows[1.0])), F.lit(rows[1.0])
    for k, n in rows.items():
        if k != 1.0:
            a, m = F.when(mult == k, F.lit(alpha(n))).otherwise(a), F.when(mult == k, F.lit(n)).otherwise(m)
    sizes = [alpha(n) for n in rows.values()]
    return Ewm(out, src, a, 1 if is_span else m, digits, (min(sizes), max(sizes)), skip)


def block_rows(specs: Sequence[Ewm]) -> int:
    low = min(s.limits()[0] for s in specs)
    high = max(s.limits()[1] for s in specs)
    if not 0 < low <= high < 1:
        raise ValueError("alpha must lie strictly between 0 and 1")
    return int(FINITE / -math.log(1 - high))


def number_rows(df: DataFrame, keys: Sequence[str], order: str, block: int) -> DataFrame:
    """Row number, block and row in block; several :func:`with_ewm` passes may share them."""
    d = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    blk = F.floor((F.col("_rn") - 1) / block)
    return d.select("*", blk.alias("_blk"), (F.col("_rn") - 1 - blk * block).alias("_i"))


def with_ewm(df: DataFrame, keys: Sequence[str], specs: Sequence[Ewm], order: str = "date", nulls: bool = True,
             block: int | None = None) -> DataFrame:
    """Add one column per spec.

    ``nulls=False`` states that the sources are complete after their ``skip`` leading rows and drops the windows that
    handle missing values.  All windows after the first use one sort (keys, block, order) on one partitioning by ``keys``.
    A frame that went through :func:`number_rows` keeps its numbering.
    """
    keys = list(keys)
    c = F.col
    d = df if "_rn" in df.columns else number_rows(df, keys, order, block or block_rows(specs))
    run = Window.partitionBy(*keys).orderBy("_blk", order)
    seen, past = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, -1)
    in_block = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_blk").rangeBetween(Window.unboundedPreceding, -1)
    n = range(len(specs))

    def col(kind: str, j: int) -> Column:
        return c(f"_{kind}{j}")

    def alpha(j: int) -> Column:
        return col("a", j) if isinstance(specs[j].alpha, Column) else F.lit(float(specs[j].alpha))

    def there(j: int) -> Column:
        return c(specs[j].src).isNotNull()

    def at(j: int) -> Column:
        """Row number of an observation, NULL elsewhere."""
        return F.when(there(j), c("_rn"))

    varying = [specs[j].alpha.alias(f"_a{j}") for j in n if isinstance(specs[j].alpha, Column)]
    if varying:
        d = d.select("*", *varying)
    if nulls:
        d = d.select("*", *[F.count(specs[j].src).over(seen).alias(f"_n{j}") for j in n],
                     *[(c("_rn") - F.last(at(j), ignorenulls=True).over(past)).alias(f"_k{j}") for j in n])
        norm = [F.pow(1 - alpha(j), col("k", j)) + alpha(j) for j in n]
        late = [there(j) & (col("n", j) > 1) & (col("k", j) > 1) for j in n]
        d = d.select("*", *[F.sum(F.when(late[j], -F.log(norm[j])).otherwise(F.lit(0.0))).over(in_block).alias(f"_e{j}") for j in n])
        stretch = [F.exp(col("e", j)) for j in n]
        weight = [F.when(col("n", j) == 1, F.lit(1.0)).when(late[j], alpha(j) / norm[j]).otherwise(alpha(j)) for j in n]
        count = [col("n", j) for j in n]
    else:
        stretch = [None] * len(specs)
        weight = [F.when(c("_rn") == specs[j].skip + 1, F.lit(1.0)).otherwise(alpha(j)) for j in n]
        count = [c("_rn") - specs[j].skip for j in n]
    scale = [F.pow(1 - alpha(j), c("_i")) if stretch[j] is None else F.pow(1 - alpha(j), c("_i")) * stretch[j] for j in n]
    d = d.select("*", *[F.sum(weight[j] * c(specs[j].src) / scale[j]).over(in_block).alias(f"_s{j}") for j in n])
    # The last observation of each block: its row, its value from its own block alone, and its stretch ...
    whole = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.select("*", *[F.when(c("_rn") == F.max(at(j)).over(whole), F.struct(
        c("_rn").alias("r"), (scale[j] * col("s", j)).alias("z"), (F.lit(1.0) if stretch[j] is None else stretch[j]).alias("g")))
        .alias(f"_l{j}") for j in n])
    # ... folded over the blocks before a row's own.
    d = d.select("*", *[F.collect_list(col("l", j)).over(earlier).alias(f"_p{j}") for j in n])

    def fold(j: int) -> Column:
        def step(acc: Column, e: Column) -> Column:
            before = acc["z"] * F.pow(1 - alpha(j), e["r"] - acc["r"]) * e["g"]
            return F.struct((e["z"] + F.coalesce(before, F.lit(0.0))).alias("z"), e["r"].alias("r"))

        return F.aggregate(col("p", j), F.struct(F.lit(None).cast("double").alias("z"), F.lit(None).cast("int").alias("r")), step)

    d = d.select("*", *[fold(j).alias(f"_c{j}") for j in n])
    ys = []
    for j in n:
        inherited = col("c", j)["z"] * F.pow(1 - alpha(j), c("_rn") - col("c", j)["r"])
        if stretch[j] is not None:
            inherited = inherited * stretch[j]
        ys.append(F.when(there(j), scale[j] * col("s", j) + F.coalesce(inherited, F.lit(0.0))))
    if nulls:
        d = d.select("*", *[ys[j].alias(f"_y{j}") for j in n])
        ys = [F.last(col("y", j), ignorenulls=True).over(seen) for j in n]
    outs = []
    for j, s in enumerate(specs):
        y = ys[j]
        if isinstance(s.min_rows, Column) or s.min_rows > 1:
            y = F.when(count[j] >= s.min_rows, y)
        outs.append((y if s.digits is None else rnd(y, s.digits)).alias(s.out))
    return d.select(*df.columns, *outs)
