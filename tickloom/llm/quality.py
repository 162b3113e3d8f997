"""Quality by nearest-neighbour voting among labelled documents in a latent semantic space.

Terms of a text are its byte trigrams (hashed into ``CELLS`` cells, square-rooted counts) and soft bins of its shape: shares of
symbols, capitals, digits, separators and line ends, of words that repeat their predecessor, of the most frequent word, and the mean word
length.  A singular value decomposition of the labelled sample gives ``DIMS`` latent directions.  The sample's vectors are broadcast; each
slice of documents is multiplied with all of them in blocks, and the ``NEIGHBOURS`` most similar vote with their similarity to the power
``SHARPNESS``, each class weighted by its share of all labels.

Labels are learnt from at most ``TRAIN_ROWS`` documents of each class and ``TRAIN_BYTES`` of text, never from held-out rows; every document
is scored over its whole text.  Null and empty texts are texts without terms and get the share of label 1; so does everything when one
class is missing (0.5 without labels); repeated rows are scored row by row; of contradicting labels the greater counts; extra columns
pass through ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.llm.text import LOWER, bounded, fold, prefix_hash, slices, span_hash, utf8, word_spans
from tickloom.llm.toxicity import chunks, training_rows

CELLS, DIMS, NEIGHBOURS, SHARPNESS = 4096, 48, 15, 6
TRAIN_ROWS, TRAIN_BYTES = 1500, 12 << 20
THRESHOLD = 0.3
BLOCK = 256  # documents whose terms are held at once
# Bins of the shape features: 0, then upwards.
_BINS = np.array([0.0, 0.01, 0.03, 0.08, 0.2, 0.5, 1.0])
_SHAPES = 8
_KIND = np.zeros((5, 256), dtype=bool)
_KIND[0, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-"]] = True
_KIND[1, 65:91] = True
_KIND[2, 48:58] = True
_KIND[3, [124, 9, 47, 92]] = True
_KIND[4, 10] = True


def terms(column: pa.Array) -> np.ndarray:
    """One row of term weights per text; a text without bytes has none."""
    raw, bounds = utf8(column)
    n, size = len(column), np.diff(bounds)
    row = np.repeat(np.arange(n), size)
    code = LOWER[raw].astype(np.uint32)
    tri = (code[:-2] * np.uint32(2654435) + code[1:-1] * np.uint32(40503) + code[2:] * np.uint32(977)) if len(raw) > 2 else np.zeros(0, np.uint32)
    tri = (tri ^ (tri >> np.uint32(13))) % np.uint32(CELLS)
    inside = row[:-2] == row[2:] if len(raw) > 2 else np.zeros(0, bool)
    counts = np.bincount(row[:-2][inside] * CELLS + tri[inside], minlength=n * CELLS)[:n * CELLS] if len(raw) > 2 else np.zeros(n * CELLS)
    grams = np.sqrt(counts.reshape(n, CELLS).astype(np.float32))
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-6)
    shape = np.zeros((n, _SHAPES), dtype=np.float32)
    full = np.maximum(size, 1)
    for k in range(5):
        shape[:, k] = np.bincount(row[_KIND[k][raw]], minlength=n) / full
    start, end = word_spans(LOWER[raw], bounds)
    h, owner = span_hash(prefix_hash(LOWER[raw]), start, end), np.searchsorted(bounds, start, side="right") - 1
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    if len(h) > 1:
        shape[:, 5] = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=n) / words
        order = np.lexsort((h, owner))
        change = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1]))))
        np.maximum.at(shape[:, 6], owner[order[change]], np.diff(np.append(change, len(h))).astype(np.float32))
        shape[:, 6] *= np.minimum(words, 50) / 50 / words
    shape[:, 7] = np.minimum(np.bincount(owner, weights=end - start, minlength=n) / words / 40, 1)
    at = np.clip(np.searchsorted(_BINS, shape, side="right") - 1, 0, len(_BINS) - 2)
    part = np.clip((shape - _BINS[at]) / (_BINS[at + 1] - _BINS[at]), 0, 1)
    bins = np.zeros((n, _SHAPES, len(_BINS)), dtype=np.float32)
    who, what = np.meshgrid(np.arange(n), np.arange(_SHAPES), indexing="ij")
    bins[who, what, at] += 1 - part
    bins[who, what, at + 1] += part
    out = np.hstack((grams, bins.reshape(n, -1) / np.sqrt(_SHAPES)))
    out[size == 0] = 0
    return out


@dataclass
class Model:
    base: float
    weights: np.ndarray | None = None  # terms x dims
    vectors: np.ndarray | None = None  # labelled documents x dims, of length 1
    labels: np.ndarray | None = None
    votes: np.ndarray | None = None

    def latent(self, column: pa.Array) -> np.ndarray:
        v = terms(column) @ self.weights
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.base)
        if self.vectors is None:
            return out
        for k in range(0, len(column), BLOCK):
            v = self.latent(column.slice(k, BLOCK))
            near = v @ self.vectors.T
            top = np.argpartition(-near, min(NEIGHBOURS, near.shape[1]) - 1, axis=1)[:, :NEIGHBOURS]
            weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARPNESS * self.votes[top]
            total = weight.sum(1)
            known = total > 0
            out[k:k + BLOCK][known] = ((weight * self.labels[top]).sum(1)[known] / total[known]).clip(0, 1)
        return out


def fit(texts: list[str | None], labels: list[int], share: float) -> Model:
    """``share``: of label 1 among all labels, held-out ones aside."""
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(share)
    x, done = np.empty((len(texts), CELLS + _SHAPES * len(_BINS)), dtype=np.float32), 0
    for _, column in chunks(texts):
        for k in range(0, len(column), BLOCK):
            part = terms(column.slice(k, BLOCK))
            x[done:done + len(part)] = part
            done += len(part)
    idf = np.log((len(x) + 1) / ((x > 0).sum(0) + 1)).astype(np.float32) + 0.2
    idf[CELLS:] = 2.0
    x *= idf
    top = np.random.default_rng(1).standard_normal((x.shape[1], DIMS + 16)).astype(np.float32)
    for _ in range(6):  # subspace iteration for the leading right singular vectors
        top = np.linalg.qr(x.T @ (x @ top))[0]
    top = (top @ np.linalg.svd(x @ top, full_matrices=False)[2].T)[:, :DIMS]
    model = Model(share, (idf[:, None] * top).astype(np.float32))
    v = x @ top
    model.vectors = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    model.labels, model.votes = y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the labelled documents outside the held-out fifth."""
    keep = fold(5) != 0
    share = labels.where(keep & F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    return fit(*training_rows(docs, labels, "quality", keep, TRAIN_ROWS, TRAIN_BYTES), 0.5 if share is None else share)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the quality of every whole text, 0 to 1; an own column of that name is replaced."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns + [name]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(shared.value.scores(piece.column("text")), pa.float64())], names=names)

    return bounded(docs).mapInArrow(task, T.StructType(docs.schema.fields + [T.StructField(name, T.DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
