"""Column builders over ordered windows.

Each takes the value column plus a window made by :func:`trailing` (or any
``WindowSpec``) and returns an unrounded ``Column``, so callers compose several
in one ``select`` and Catalyst merges equal specs into one ``Window`` node.
A symbol's partition holds one row per day once the table is de-duplicated, so
its size is bounded by the calendar and not by the number of source rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec, functions as F

from tickloom.functions.numeric import adjusted_skew, div


def ordered(by: Sequence[str], order: str = "date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def trailing(by: Sequence[str], rows: int, order: str = "date") -> WindowSpec:
    return ordered(by, order).rowsBetween(-(rows - 1), 0)


def centred(by: Sequence[str], rows: int, order: str = "date") -> WindowSpec:
    """Centred frame; an even width leans one row towards the past."""
    after = (rows - 1) // 2
    return ordered(by, order).rowsBetween(-(rows - 1 - after), after)


def before(by: Sequence[str], order: str = "date") -> WindowSpec:
    """Everything strictly before the current row."""
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)


def up_to(by: Sequence[str], order: str = "date") -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def whole(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by)


def mean(c: Column, w: WindowSpec) -> Column:
    return F.avg(c).over(w)


def std(c: Column, w: WindowSpec, min_rows: int = 2) -> Column:
    sd = F.stddev_samp(c).over(w)
    return sd if min_rows <= 2 else F.when(F.count(c).over(w) >= min_rows, sd)


def momentum(c: Column, rows: int, w: WindowSpec) -> Column:
    prev = F.lag(c, rows).over(w)
    return div(c - prev, F.abs(prev))


def zscore(c: Column, w: WindowSpec) -> Column:
    return div(c - F.avg(c).over(w), F.stddev_samp(c).over(w))


def skew(c: Column, w: WindowSpec) -> Column:
    return adjusted_skew(F.skewness(c).over(w), F.count(c).over(w), F.stddev_samp(c).over(w))


def share_positive(c: Column, w: WindowSpec) -> Column:
    """Percent of window rows above zero; a NULL counts as not positive."""
    return F.avg(F.when(c > 0, F.lit(1.0)).otherwise(F.lit(0.0))).over(w) * 100


def pct_rank(c: Column, w: WindowSpec, min_rows: int) -> Column:
    """Share of the window at or below the current value (windows are small: O(rows * width))."""
    at_or_below = F.size(F.filter(F.collect_list(c).over(w), lambda v: v <= c))
    return F.when(F.count(c).over(w) >= min_rows, at_or_below / F.count(F.lit(1)).over(w))


def quantile(c: Column, q: float, w: WindowSpec, min_rows: int) -> Column:
    return F.when(F.count(c).over(w) >= min_rows, F.percentile(c, F.lit(q)).over(w))


def tail_mean(c: Column, q: float, w: WindowSpec, min_rows: int) -> Column:
    """Mean of the window values at or below the window's own ``q`` quantile."""
    cut = F.percentile(c, F.lit(q)).over(w)
    tail = F.filter(F.collect_list(c).over(w), lambda v: v <= cut)
    total = F.aggregate(tail, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.count(c).over(w) >= min_rows, div(total, F.size(tail)))


def corr(a: Column, b: Column, w: WindowSpec, min_rows: int) -> Column:
    """Rolling Pearson; NULL while fewer than ``min_rows`` complete pairs are in the frame."""
    both = F.when(a.isNotNull() & b.isNotNull(), F.lit(1))
    r = F.corr(a, b).over(w)
    return F.when((F.count(both).over(w) >= min_rows) & ~F.isnan(r), r)


def island(sign: Column, w: WindowSpec) -> Column:
    """1 where ``sign`` differs from the previous row, for a running-sum island id."""
    prev = F.lag(sign).over(w)
    return F.when(prev.isNull() | (prev != sign), F.lit(1)).otherwise(F.lit(0))
