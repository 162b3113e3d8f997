"""Scalar numeric helpers shared by every operator."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def rnd(c: Column, n: int) -> Column:
    """Round half-to-even at ``n`` decimals.

    The value is first snapped to six further decimals so that an exact decimal
    tie is decided by its decimal value and not by the last bit of a float sum,
    whose order differs between partitions.  ``+ 0.0`` folds -0.0 into 0.0.
    """
    k = 10.0**n
    return F.rint(F.rint(c * F.lit(k * 1e6)) / F.lit(1e6)) / F.lit(k) + F.lit(0.0)


def div(a: Column, b: Column) -> Column:
    """``a / b`` with NULL for a zero or missing denominator."""
    return F.try_divide(a, b)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def adjusted_skew(g1: Column, n: Column, sd: Column) -> Column:
    """Sample-adjusted skewness from the population value; 0 on a constant group."""
    n = n.cast("double")
    return F.when(n >= 3, F.when(sd == 0, F.lit(0.0)).otherwise(F.sqrt(n * (n - 1)) / (n - 2) * g1))


def adjusted_kurtosis(g2: Column, n: Column, sd: Column) -> Column:
    """Sample-adjusted excess kurtosis from the population value; 0 on a constant group."""
    n = n.cast("double")
    full = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.when(sd == 0, F.lit(0.0)).otherwise(full))


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided normal tail probability, by the Abramowitz-Stegun 7.1.26 fit of erfc (|error| < 1.5e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = F.lit(0.0)
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + F.lit(a)) * t
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def student_two_sided_p(t: Column, df: Column, exact_up_to: int = 1000) -> Column:
    """Two-sided tail probability of Student's t with a whole number of degrees of freedom.

    The finite sums of Abramowitz-Stegun 26.7.3 and 26.7.4; beyond ``exact_up_to`` degrees the normal law of 26.7.8.
    """
    df = df.cast("int")
    cos2 = df / (df + t * t)
    sin, cos = F.abs(t) / F.sqrt(df + t * t), F.sqrt(cos2)
    odd = df % 2

    def add(acc: Column, k: Column) -> Column:
        ratio = (2 * k - 1 + odd) / (2 * k + odd)
        term = acc["term"] * ratio * cos2
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    last = F.floor((F.least(df, F.lit(exact_up_to)) - odd) / 2).cast("int") - 1
    terms = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    total = F.aggregate(terms, one, add)["sum"]
    angle = F.asin(sin)
    inside = F.when(odd == 0, sin * total).when(df == 1, angle * (2 / math.pi)).otherwise((angle + sin * cos * total) * (2 / math.pi))
    z = F.abs(t) * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return F.when(df > exact_up_to, normal_two_sided_p(z)).when(df >= 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - inside)))


def signed(c: Column, n: int) -> Column:
    """``+1.23`` style text of an already finite number."""
    return F.format_string(f"%+.{n}f", rnd(c, n))


def fixed(c: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", rnd(c, n))

