"""Co-moments of many columns over every set of complete rows, from one pass.

"Complete" depends on the columns that are asked about, and a chain of filters asks about fewer and fewer columns.  Rows are therefore
summed up per pattern of missing values: count, means, and the matrix of central cross products of the columns that are there.  Such
sums can be merged, so the rows that are complete over any set of columns are the merged patterns that lack none of them, and no later
step looks at a row again.

Tasks reduce their rows to one record per pattern; records are merged in two steps (a bounded share of the tasks, then those results), so
no task gets the records of all others.  The merge is the pairwise update of means and central products: no cancellation between large
sums, and a constant column has exactly zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

#: Patterns that a task holds before it hands them on, and the shares that the first merge is dealt into.
PATTERNS, SHARES = 512, 64
SCHEMA = "missing array<boolean>, n long, mean array<double>, product array<double>"


def _block(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and central cross products of complete rows; differences to the first row keep constants exact."""
    d = x - x[0]
    mean = d.mean(axis=0)
    d = d - mean
    return len(x), x[0] + mean, d.T @ d


def merge(parts: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Pairwise update of (count, means, central cross products)."""
    total = None
    for n, mean, product in parts:
        if total is None:
            total = n, mean, product
            continue
        n0, mean0, product0 = total
        step = mean - mean0
        total = n0 + n, mean0 + step * (n / (n0 + n)), product0 + product + np.outer(step, step) * (n0 * n / (n0 + n))
    return total


def _record(missing: np.ndarray, part: tuple[int, np.ndarray, np.ndarray]) -> dict:
    return {"missing": missing.tolist(), "n": int(part[0]), "mean": part[1].tolist(), "product": part[2].ravel().tolist()}


def _merged(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` (the record and a column ``share``) with all records of a group in one."""
    def combine(group: pd.DataFrame) -> pd.DataFrame:
        k = len(group["mean"].iloc[0])
        part = merge((n, np.asarray(m), np.asarray(p).reshape(k, k)) for n, m, p in zip(group["n"], group["mean"], group["product"]))
        return pd.DataFrame([_record(np.logical_or.reduce(np.stack(group["missing"])), part)])

    first = df.groupBy(*by, "share").applyInPandas(combine, SCHEMA)
    return first.withColumn("all", F.lit(0)).groupBy(*(by or ["all"])).applyInPandas(combine, SCHEMA)


def comoments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per pattern of missing values: ``missing`` (a flag per column), n, mean, and product (row by row; 0 where missing).

    NaN counts as missing.  An empty table gives no rows.
    """
    names, k = list(columns), len(columns)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}

        def given() -> pa.RecordBatch:
            out = [_record(np.frombuffer(key, dtype=bool), part) for key, part in held.items()]
            held.clear()
            share = TaskContext.get().partitionId() % SHARES
            return pa.RecordBatch.from_pylist([o | {"share": share} for o in out], schema=_ARROW)

        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(k)])
            gone = np.isnan(x)
            patterns, which = np.unique(gone, axis=0, return_inverse=True)
            which = which.ravel()
            for p, pattern in enumerate(patterns):
                n, mean, product = _block(x[which == p][:, ~pattern])
                m, c = np.zeros(k), np.zeros((k, k))
                m[~pattern], c[np.ix_(~pattern, ~pattern)] = mean, product
                key = pattern.tobytes()
                held[key] = merge([held[key], (n, m, c)]) if key in held else (n, m, c)
            if len(held) > PATTERNS:
                yield given()
        if held:
            yield given()

    records = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(reduce, SCHEMA + ", share int")
    return _merged(records, ["missing"])


_ARROW = pa.schema([("missing", pa.list_(pa.bool_())), ("n", pa.int64()), ("mean", pa.list_(pa.float64())),
                    ("product", pa.list_(pa.float64())), ("share", pa.int32())])


def complete(patterns: DataFrame) -> DataFrame:
    """The sums over rows in which no column is missing: exactly one row, with n = 0 and NULL sums where there is none."""
    whole = patterns.where(~F.exists("missing", lambda m: m))
    return whole.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("mean").alias("mean"), F.max("product").alias("product"))


def complete_over(patterns: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sums over rows in which no wanted column is missing.  ``wanted`` is one row with the array of flags ``wanted``."""
    one = F.broadcast(wanted.select(F.lit(1).alias("_k"), "wanted"))  # one row
    fits = patterns.withColumn("_k", F.lit(1)).join(one, "_k").where(
        ~F.exists(F.zip_with("missing", "wanted", lambda m, w: m & w), lambda x: x))
    return _merged(fits.select("missing", "n", "mean", "product", F.pmod(F.xxhash64("missing"), F.lit(SHARES)).alias("share")), [])


def variances(sums: DataFrame, k: int) -> DataFrame:
    """(n, i, variance): the sample variance of every column; NULL below two rows."""
    at = F.sequence(F.lit(0), F.lit(k - 1))
    v = F.transform(at, lambda i: F.when(F.col("n") > 1, F.get("product", i * k + i) / (F.col("n") - 1)))
    return sums.select("n", F.posexplode(v).alias("i", "variance"))


def correlations(sums: DataFrame, k: int) -> DataFrame:
    """(i, j, r) for i < j: Pearson's r; NULL where a column does not vary."""
    def cell(a: Column, b: Column) -> Column:
        return F.get("product", a * k + b)

    def pair(i: Column, j: Column) -> Column:
        scale = F.sqrt(cell(i, i)) * F.sqrt(cell(j, j))
        return F.struct(i.alias("i"), j.alias("j"), F.when(scale > 0, cell(i, j) / scale).alias("r"))

    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k - 1)),
                                  lambda j: F.transform(F.sequence(F.lit(0), j - 1), lambda i: pair(i, j))))
    return sums.where("n > 0").select(F.inline(pairs) if k > 1 else F.inline(F.array(pair(F.lit(0), F.lit(0))))).where("i < j")
