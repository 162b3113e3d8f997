"""Scoring text with any model: one model per worker process, batches of like length, failing rows kept with their error.

A model is slow to load and pads a batch to its longest text.  Each Python worker loads it once and keeps it for all its tasks, and the
texts of an Arrow batch are scored in order of length, ``batch`` at a time.  When a batch fails it is split in two until the failing texts
are alone: they get no score and the error's message, all others get theirs, and nothing is scored by another model on the quiet.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tickloom.functions.numeric import rnd
from tickloom.operators.sentiment import TOKEN_SPLIT

Model = Callable[[list[str]], Sequence[float]]
#: Loaded models of this worker process, by scorer.
_LOADED: dict[str, Model] = {}


def _attempt(model: Model, texts: list[str]) -> tuple[list[float | None], list[str | None]]:
    """Scores and errors of ``texts``; a failing batch is halved until its failing texts stand alone."""
    try:
        scores = [float(s) for s in model(texts)]
        if len(scores) != len(texts):
            raise ValueError(f"{len(scores)} scores for {len(texts)} texts")
        return scores, [None] * len(texts)
    except Exception as e:  # any model may fail in any way
        if len(texts) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    half = len(texts) // 2
    a, b = _attempt(model, texts[:half]), _attempt(model, texts[half:])
    return a[0] + b[0], a[1] + b[1]


def scorer(load: Callable[[], Model], batch: int = 16):
    """A vectorised function of a text column with the fields ``score`` and ``error``; a missing text has neither."""
    name = uuid.uuid4().hex

    @F.pandas_udf("score double, error string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if name not in _LOADED:
            _LOADED[name] = load()
        model = _LOADED[name]
        for texts in batches:
            scores, errors = np.full(len(texts), np.nan), np.full(len(texts), None, dtype=object)
            there = np.flatnonzero(texts.notna().to_numpy())
            there = there[np.argsort(texts.iloc[there].str.len().to_numpy(), kind="stable")]
            for k in range(0, len(there), batch):
                at = there[k:k + batch]
                s, e = _attempt(model, texts.iloc[at].tolist())
                scores[at], errors[at] = [np.nan if v is None else v for v in s], e
            yield pd.DataFrame({"score": pd.Series(scores).astype("Float64").mask(np.isnan(scores)), "error": errors})

    return score


def scored(df: DataFrame, text: str, load: Callable[[], Model], batch: int = 16) -> DataFrame:
    """``df`` with ``score`` (4 decimals) and ``error``."""
    out = df.withColumn("_scored", scorer(load, batch)(F.col(text)))
    return out.select(*df.columns, rnd(F.col("_scored.score"), 4).alias("score"), F.col("_scored.error").alias("error"))


def token_weights(labelled: DataFrame, text: str, label: str, min_rows: int = 20, terms: int = 500) -> DataFrame:
    """(token, weight): the log ratio of positive to negative rows that hold a token, for the ``terms`` most frequent ones.

    Counts are merged map-side; the result is bounded by ``terms``.
    """
    tokens = labelled.select(F.col(label).alias("y"), F.explode(F.array_distinct(F.split(F.lower(F.col(text)), TOKEN_SPLIT))).alias("token"))
    n = tokens.where("token <> ''").groupBy("token").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    often = n.where(F.col("p") + F.col("q") >= min_rows).orderBy((F.col("p") + F.col("q")).desc(), "token").limit(terms)
    return often.select("token", rnd(F.log((F.col("p") + 1) / (F.col("q") + 1)), 6).alias("weight"))


class LinearModel:
    """Mean weight of the known tokens of a text, 0 without any."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.split = weights, re.compile(TOKEN_SPLIT)

    def __call__(self, texts: list[str]) -> list[float]:
        out = []
        for t in texts:
            known = [self.weights[w] for w in self.split.split(t.lower()) if w in self.weights]
            out.append(sum(known) / len(known) if known else 0.0)
        return out


def linear_scorer(weights: DataFrame) -> Callable[[], Model]:
    """A loader of the linear model of a weight table, which :func:`token_weights` bounds."""
    shared = weights.sparkSession.sparkContext.broadcast({r.token: r.weight for r in weights.collect()})
    return lambda: LinearModel(shared.value)
