"""Hard negatives by cover trees over norm-augmented candidates.

A candidate x becomes (x, sqrt(M^2 - |x|^2)) with M the largest norm, an anchor q becomes (q, 0).  Inner products stay what they are, and a
node with centre c and covering radius r bounds them: q.c - |q| r <= q.x <= q.c + |q| r for everything it covers.  An anchor asks for the
best rows of its own label, then, per positive, for the best rows of other labels whose score lies in a window below the positive's.

1. Rows that repeat a vector and a label need only their ``positives + 1`` least ids (their scores are equal), found by a per-task limit.
2. Candidates go to the nearest of at most ``PIVOTS`` pivots, the greedy net of ``SAMPLE`` rows; cells above ``SHARD`` rows are split by
   hash.  Every shard gets a cover tree: a node's members are covered greedily by centres at half its radius, down to ``LEAF`` rows or
   radius 0.  A tree is one row of a written table.
3. Anchors go around in chunks of ``CHUNK_BYTES`` (a broadcast of that size at most; more anchors mean more passes).  A task descends
   its trees best first for blocks of anchors: the node with the highest bound comes next, anchors whose window or best results so far
   exclude a node do not look at it, and leaves are decided on exact integer products.  Per task and question at most k rows leave.
4. The best k of all tasks are ranked per question.

Nothing is approximate: bounds carry a margin for rounding, and every reported score is an integer product.

Defined cases: rows without id, label or vector, with an empty vector, or with a null or non-finite entry take no part.  Rows that repeat
id, label and vector count once; rows that share an id only are rows of their own, and never positives or negatives of their own id.  Ties
in score go to the smaller id.  An anchor without another row of its label gives no rows, as does a positive with an empty window (always
so for a negative score) and an empty table.  Vectors of several lengths are refused with a ValueError, as are scores beyond 62 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.llm.text import bounded, stored
from tickloom.llm.whitening import grid, matrix, usable

PIVOTS, SAMPLE = 256, 8192
SHARD, LEAF, BLOCK, GROUP = 4096, 32, 512, 64
CHUNK_BYTES = 16 << 20
_LOW, _HIGH = -(1 << 62), 1 << 62


def augmented(x: np.ndarray, largest: int) -> np.ndarray:
    """Rows with the coordinate that gives all of them the norm sqrt(``largest``)."""
    y = x.astype(np.float64)
    return np.column_stack((y, np.sqrt(np.maximum(0.0, largest - np.square(y).sum(axis=1)))))


def _distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(rows - centre).sum(axis=1))


def net(rows: np.ndarray, most: int) -> np.ndarray:
    """Positions of up to ``most`` rows, each the farthest from those before it."""
    chosen, far = [0], _distances(rows, rows[0])
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(rows, rows[chosen[-1]]))
    return np.asarray(chosen)


@dataclass(frozen=True)
class Tree:
    """Nodes in order of creation: centre (a row), radius, the span [start, end) of ``order`` it covers, its children [first, last)."""
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    order: np.ndarray


def build(rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree: the children of a node cover its members within half its radius, their centres lie farther apart than that.

    Distances come from products, ``GROUP`` possible centres against all uncovered members at a time; a radius carries a margin for what
    such a difference of squares may lose.
    """
    order, square = np.arange(len(rows)), np.square(rows).sum(axis=1)
    margin = 1e-11 * float(square.max(initial=0.0))

    def far(some: np.ndarray, left: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(square[some][:, None] + square[left] - 2 * (rows[some] @ rows[left].T), 0.0))

    centre, reach, start, end, first, last = [0], [float(far(order[:1], order).max())], [0], [len(rows)], [0], [0]
    node = 0
    while node < len(centre):
        a, b, half = start[node], end[node], reach[node] / 2
        if b - a > leaf and half > 0:
            first[node], at = len(centre), a
            left = order[a:b]
            left = np.concatenate(([centre[node]], left[left != centre[node]]))
            while len(left):
                some = left[:GROUP]
                d = far(some, left)
                free = np.ones(len(left), dtype=bool)
                for k in range(len(some)):
                    if free[k]:
                        mine = free & (d[k] <= half)
                        mine[k] = True
                        inside = left[mine]
                        order[at:at + len(inside)] = inside
                        centre.append(int(some[k]))
                        reach.append(float(d[k][mine].max()))
                        start.append(at)
                        at += len(inside)
                        end.append(at)
                        first.append(0)
                        last.append(0)
                        free &= ~mine
                left = left[free]
            last[node] = len(centre)
        node += 1
    radius = np.sqrt(np.square(reach) + margin)
    return Tree(*[np.asarray(v) for v in (centre, radius, start, end, first, last, order)])


@dataclass(frozen=True)
class Questions:
    """Per question: its anchor (a row of ``x``), label, id, whether the label must be the same, and the window [low, high] of scores."""
    x: np.ndarray
    anchor: np.ndarray
    label: np.ndarray
    id: np.ndarray
    same: bool
    low: np.ndarray
    high: np.ndarray
    k: int


class _Best:
    """The k best (score, id) of each question so far, higher scores and then smaller ids first."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.k = np.full((n, k), _LOW, dtype=np.int64), np.full((n, k), _HIGH, dtype=np.int64), k

    def floor(self, who: np.ndarray) -> np.ndarray:
        return self.score[who, -1]

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Rows of ``score`` belong to the questions ``who``, columns to ``ids``; only where ``fits``."""
        fits = fits & (score >= self.floor(who)[:, None])
        if score.shape[1] > self.k:
            masked = np.where(fits, score, _LOW)
            fits &= score >= np.partition(masked, -self.k, axis=1)[:, -self.k][:, None]
        r, c = np.nonzero(fits)
        if not len(r):
            return
        some = np.unique(r)
        q = np.concatenate((r, np.repeat(some, self.k)))
        s = np.concatenate((score[r, c], self.score[who[some]].ravel()))
        i = np.concatenate((ids[c], self.id[who[some]].ravel()))
        by = np.lexsort((i, -s, q))
        q, s, i = q[by], s[by], i[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.score[who[q[top]], place[top]] = s[top]
        self.id[who[q[top]], place[top]] = i[top]


def descend(tree: Tree, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, ask: Questions, best: _Best, who: np.ndarray) -> None:
    """Best-first descent of one tree for the questions ``who``; ``best`` takes what they find."""
    anchors, inverse = np.unique(ask.anchor[who], return_inverse=True)
    exact = ask.x[anchors]
    q = exact.astype(np.float64)
    norm, rows = np.sqrt(np.square(q).sum(axis=1)), x.astype(np.float64)
    # Products of doubles are exact as long as every partial sum is below 2^53.
    safe = float(norm.max(initial=0.0)) * float(np.sqrt(np.square(rows).sum(axis=1).max(initial=0.0))) < 2.0**52

    def products(some: np.ndarray, at: np.ndarray) -> np.ndarray:
        own, back = np.unique(inverse[some], return_inverse=True)
        found = (q[own] @ rows[at].T).astype(np.int64) if safe else exact[own] @ x[at].T
        return found[back]

    def open_to(some: np.ndarray, score: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which questions a node may still answer, and the upper bounds."""
        reach = norm[inverse[some]] * radius
        reach = reach + 1e-9 * (np.abs(score) + reach) + 1e-6
        upper, least = score + reach, np.maximum(ask.low[who[some]], best.floor(who[some]))
        return (upper >= least) & (score - reach <= ask.high[who[some]]), upper

    every = np.arange(len(who))
    score = products(every, tree.centre[:1])[:, 0]
    fine, upper = open_to(every, score, tree.radius[0])
    heap = [(-upper[fine].max(), 0, every[fine], score[fine])] if fine.any() else []
    while heap:
        _, node, some, score = heapq.heappop(heap)
        fine, _ = open_to(some, score, tree.radius[node])
        some = some[fine]
        if not len(some):
            continue
        if tree.first[node] == tree.last[node]:
            at = tree.order[tree.start[node]:tree.end[node]]
            _verify(ask, best, who[some], products(some, at), ids[at], labels[at])
            continue
        children = np.arange(tree.first[node], tree.last[node])
        score = products(some, tree.centre[children])
        single = tree.end[children] - tree.start[children] == 1
        if single.any():
            at = tree.centre[children[single]]
            _verify(ask, best, who[some], score[:, single], ids[at], labels[at])
        for j in np.flatnonzero(~single):
            fine, upper = open_to(some, score[:, j], tree.radius[children[j]])
            if fine.any():
                heapq.heappush(heap, (-upper[fine].max(), int(children[j]), some[fine], score[fine, j]))


def _verify(ask: Questions, best: _Best, who: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
    fits = (score >= ask.low[who][:, None]) & (score <= ask.high[who][:, None]) & (ids[None, :] != ask.id[who][:, None])
    fits &= (labels[None, :] == ask.label[who][:, None]) == ask.same
    best.add(who, score, ids, fits)


def _packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


_NODES = (("centre", np.int32), ("radius", np.float64), ("start", np.int32), ("end", np.int32), ("first", np.int32), ("last", np.int32),
          ("order", np.int32))


def forest(candidates: DataFrame, largest: int, sample: int = SAMPLE, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """The written trees over all candidates (id, label, x), one row per shard."""
    spark = candidates.sparkSession
    # The pivots are fitted on about ``sample`` rows, drawn by hash so that any run draws the same; every row is indexed.
    n = candidates.count()
    draw = F.pmod(F.xxhash64("id", "label", "x"), F.lit(1 << 30)) < F.lit(max(1, sample * (1 << 30) // n))
    drawn = [r.x for r in candidates.where(draw).select("x").collect()] or [candidates.first().x]
    cells = max(1, min(PIVOTS, -(-n // shard)))
    points = augmented(np.asarray(drawn, dtype=np.int64), largest)
    pivots = spark.sparkContext.broadcast(points[net(points, cells)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        half = np.square(p).sum(axis=1) / 2
        for b in batches:
            if b.num_rows:
                cell = (augmented(matrix(b.column(2)), largest) @ p.T - half).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=["id", "label", "x", "cell"])

    placed = stored(bounded(candidates.select("id", "label", "x")).mapInArrow(assign, "id long, label long, x array<long>, cell int"), "cells")
    sizes = dict(placed.groupBy("cell").count().collect())
    parts = F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, -(-n // shard))])
    salted = placed.withColumn("part", F.pmod(F.xxhash64("id", "label"), parts[F.col("cell")]))

    def plant(group: pa.Table) -> pa.Table:
        x = matrix(group.column("x").combine_chunks())
        tree = build(augmented(x, largest), leaf)
        out = {"n": pa.array([len(x)], pa.int32()), "x": pa.array([_packed(x)], pa.binary())}
        for name in ("id", "label"):
            out[name] = pa.array([_packed(group.column(name).to_numpy())], pa.binary())
        for name, kind in _NODES:
            out[name] = pa.array([_packed(getattr(tree, name).astype(kind))], pa.binary())
        return pa.table(out)

    schema = "n int, x binary, id binary, label binary, " + ", ".join(f"`{name}` binary" for name, _ in _NODES)
    return stored(salted.groupBy("cell", "part").applyInArrow(plant, schema), "trees")


def _ask(trees: DataFrame, ask: Questions) -> DataFrame:
    """(question, score, id): the k best rows of every question over all trees."""
    shared = trees.sparkSession.sparkContext.broadcast(ask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = shared.value
        best = _Best(len(ask.anchor), ask.k)
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], np.int64).reshape(row["n"], -1)
                tree = Tree(*[np.frombuffer(row[name], kind) for name, kind in _NODES])
                ids, labels = np.frombuffer(row["id"], np.int64), np.frombuffer(row["label"], np.int64)
                for a in range(0, len(ask.anchor), BLOCK):
                    descend(tree, x, ids, labels, ask, best, np.arange(a, min(a + BLOCK, len(ask.anchor))))
        q, k = np.nonzero(best.id < _HIGH)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best.score[q, k]), pa.array(best.id[q, k])],
                                         names=["question", "score", "id"])

    found = bounded(trees).mapInArrow(run, "question int, score long, id long")
    place = F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= ask.k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100),
         high: tuple[int, int] = (100, 100), chunk_bytes: int = CHUNK_BYTES, **tree: int) -> DataFrame:
    """Hard negatives of the rows of (id, label, x) that meet ``anchors``; x is a long array.

    For each anchor and each of its ``positives`` best rows of the same label: the first ``negatives`` rows of other labels with
    low <= score / positive's score <= high, both as fractions, decided on integers.
    """
    spark = rows.sparkSession
    rows = stored(rows.where("id IS NOT NULL AND label IS NOT NULL AND size(x) > 0").select(
        F.col("id").cast("long"), F.col("label").cast("long"), "x").distinct(), "vectors")
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, dims, most, top, asking = rows.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), F.max(norm),
                                          F.sum(anchors.cast("int"))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not asking:
        return spark.createDataFrame([], schema)
    if dims != most or top >= 2.0**62:
        raise ValueError(f"vectors of several lengths ({dims} to {most}) or too large scores (squared norm {top:g})")
    need = W.partitionBy("x", "label").orderBy("id")
    candidates = rows.withColumn("_n", F.row_number().over(need)).where(F.col("_n") <= max(positives + 1, negatives)).select("id", "label", "x")
    trees = forest(candidates, int(top), **tree)
    chunks = -(-asking * 8 * dims // chunk_bytes)
    out = None
    for chunk in range(chunks):
        mine_now = rows.where(anchors & (F.pmod(F.xxhash64("id", "x"), F.lit(chunks)) == chunk)).collect()
        if not mine_now:
            continue
        x = np.asarray([r.x for r in mine_now], dtype=np.int64)
        ids, labels = (np.asarray([r[c] for r in mine_now], dtype=np.int64) for c in ("id", "label"))
        ask = Questions(x, np.arange(len(x)), labels, ids, True, np.full(len(x), _LOW), np.full(len(x), _HIGH), positives)
        # At most ``positives`` rows per anchor of the chunk.
        found = sorted((r.question, r.rank, r.id, r.score) for r in _ask(trees, ask).collect())
        at, positive, score = (np.asarray([f[k] for f in found], dtype=np.int64) for k in (0, 2, 3))
        # floor and ceiling of fractions of Python's integers
        floor = np.asarray([-(-low[0] * int(s) // low[1]) for s in score], dtype=np.int64)
        ceiling = np.asarray([high[0] * int(s) // high[1] for s in score], dtype=np.int64)
        ask = replace(ask, anchor=at, label=labels[at], id=ids[at], same=False, low=floor, high=ceiling, k=negatives)
        names = spark.createDataFrame(list(zip(range(len(at)), ids[at].tolist(), positive.tolist(), score.tolist())),
                                      "question int, anchor_id long, positive_id long, positive_score long")
        part = stored(_ask(trees, ask).join(names, "question").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")), "negatives")
        out = part if out is None else out.unionByName(part)
    return out


def report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of (vec_id, embedding, label): anchors are ids divisible by 100, labels of ids divisible by 7 move up by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), label.alias("label"),
                                                               grid(F.col("embedding"), 256).alias("x"))
    return mine(rows, F.col("id") % 100 == 0)
