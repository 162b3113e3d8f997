"""Toxicity by a gap-weighted subsequence kernel, Nystroem landmarks and a linear support vector machine.

A text is a list of sentences, a sentence a set of words.  A word is a run without white space, reduced to its letters (``i.d-i*o_t`` is one
word, and so are single letters in a row), lower-cased in ASCII and fenced by ``^`` and ``$``.  The kernel counts common subsequences of
three characters, each weighted by ``DECAY`` to the power of the span it needs in either word, related almost only to the landmark's own value (``OWN`` is the word's share of the
norm), and raised to ``POWER``: characters put into a word lengthen it and lower the kernel little, missing ones destroy it.  Landmarks are the character sequences that tell toxic from other training documents best, chosen one after
the other so that each covers documents the earlier ones cover least.  A sentence is the greatest kernel value of its words at each
landmark (values under ``ACTIVE`` count as 0); a text is the sum of its sentences per ``WORDS`` words, so one chance likeness in a long
text weighs little; K_mm^(-1/2) maps it to the space where a linear machine separates toxic from other labelled texts.  A logistic curve
turns margins into scores.

Labels are learnt from at most ``TRAIN_ROWS`` documents of each class and ``TRAIN_BYTES`` of text; every document is scored over its
whole text.  Null, empty and wordless texts get the score of a text without conspicuous words; without labels of both classes every score
is the share of toxic labels (0.5 where there are none); repeated rows are scored row by row; of contradicting labels of one document the
toxic one counts; extra columns pass through ``score``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.llm.text import LOWER, bounded, fold, fresh, mix, prefix_hash, slices, span_hash, utf8

ORDER, DECAY, ACTIVE = 3, 0.9, 0.6
OWN = 0.1  # share of a word's own kernel value in the norm; with one half, letters put into a word would count like other letters in it
POWER = 6  # of the related kernel value: sets words with a whole landmark in them apart from those with most of one
LANDMARKS, GRAMS = 48, (4, 5, 6)
SUPPORT = 0.04  # least share of toxic documents with a landmark: fewer is chance or copies
TRAIN_ROWS, TRAIN_BYTES = 1500, 12 << 20
THRESHOLD = 0.7
CHUNK, WORDS_AT_ONCE = 4096, 1 << 17  # words compared at once, words prepared at once
WORDS = 50  # to which the kernel values of a text are related
WIDTH = 24  # letters compared at once; longer words are compared in overlapping parts

_LENGTHS = ((0, 8), (8, 11), (11, 15), (15, WIDTH + 2))  # words of like length are compared together
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words end to end, each word's start and end there, its row, and its sentence (counted over the column)."""
    raw, bounds = utf8(column)
    raw = LOWER[raw]
    dark = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    before, after = np.concatenate(([False], dark)), np.concatenate((dark, [False]))
    first, last = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
    letter = _LETTER[raw]
    seen = np.concatenate(([0], np.cumsum(letter)))
    start, end = seen[first], seen[last]
    row = np.searchsorted(bounds, first, side="right") - 1
    newline = np.concatenate(([0], np.cumsum(raw == 10)))[first]
    stop = _STOP[raw[last - 1]] if len(last) else np.zeros(0, bool)
    sentence = newline + np.concatenate(([0], np.cumsum(stop)[:-1])) + row if len(first) else newline
    one = end - start == 1
    joined = one & np.concatenate(([False], one[:-1] & (row[1:] == row[:-1]))) if len(one) else one
    head = np.flatnonzero(~joined)
    tail = np.append(head[1:], len(one)) - 1 if len(head) else head
    keep = end[tail] > start[head]
    head, tail = head[keep], tail[keep]
    return raw[letter], start[head], end[tail], row[head], sentence[head]


def matrix(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fenced words as rows of bytes, and each row's word; a word longer than ``WIDTH`` takes several overlapping rows."""
    step = WIDTH // 2
    parts = np.maximum(1, -(-(end - start - WIDTH) // step) + 1)
    word = np.repeat(np.arange(len(start)), parts)
    part = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    lo = start[word] + part * step
    hi = np.minimum(lo + WIDTH, end[word])
    at = lo[:, None] + np.arange(WIDTH)
    out = np.zeros((len(word), WIDTH + 2), dtype=np.uint8)
    out[:, 1:-1] = np.where(at < hi[:, None], letters[np.minimum(at, max(len(letters) - 1, 0))], 0) if len(word) else 0
    out[:, 0] = np.where(part == 0, 94, 0)
    whole = np.flatnonzero(hi == end[word])
    out[whole, 1 + (hi - lo)[whole]] = 36
    return out, word


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The subsequence kernel of each row of ``a`` with the same row of ``b`` (or its only row); zero bytes match nothing."""
    n, s, t = len(a), a.shape[1], b.shape[1]
    if n > CHUNK:
        return np.concatenate([kernel(a[k:k + CHUNK], b if len(b) == 1 else b[k:k + CHUNK]) for k in range(0, n, CHUNK)])
    same = [[((a[:, i] == b[:, j]) & (a[:, i] > 0)).astype(np.float32) * np.float32(DECAY ** 2) for j in range(t)] for i in range(s)]
    total = np.zeros(n, dtype=np.float32)
    inner = None  # weights of common subsequences of the previous length that end before (i, j), up to there
    for p in range(1, ORDER + 1):
        here = [[None] * (t + 1) for _ in range(s + 1)]
        zero = np.zeros(n, dtype=np.float32)
        for j in range(t + 1):
            here[0][j] = zero
        for i in range(1, s + 1):
            row, here[i][0] = zero, zero
            for j in range(1, t + 1):
                m = same[i - 1][j - 1] if p == 1 else same[i - 1][j - 1] * inner[i - 1][j - 1]
                if p == ORDER:
                    total += m
                else:
                    row = np.float32(DECAY) * row + m
                    here[i][j] = np.float32(DECAY) * here[i - 1][j] + row
        inner = here
    return total


def _pairs(rows: np.ndarray, gaps: tuple[int, ...]) -> np.ndarray:
    """Per row a set of 128 bits for its pairs of characters at the given distances."""
    out = np.zeros((len(rows), 2), dtype=np.uint64)
    wide = rows.astype(np.uint16)
    for gap in gaps:
        for i in range(rows.shape[1] - gap):
            code = (wide[:, i] * np.uint16(31) + wide[:, i + gap] * np.uint16(101)) & np.uint16(127)
            bit = np.where((rows[:, i] > 0) & (rows[:, i + gap] > 0), np.uint64(1) << (code & 63).astype(np.uint64), np.uint64(0))
            high = code > 63
            out[:, 0] |= np.where(high, np.uint64(0), bit)
            out[:, 1] |= np.where(high, bit, np.uint64(0))
    return out


@dataclass
class Model:
    landmarks: list[bytes]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def __post_init__(self):
        self.rows = [np.frombuffer(x, dtype=np.uint8)[None, :] for x in self.landmarks]
        self.own = [float(kernel(r, r)[0]) for r in self.rows]
        self.pairs = [_pairs(r, (1,))[0] for r in self.rows]

    def words(self, rows: np.ndarray) -> np.ndarray:
        """Related kernel values (word parts x landmarks); words without most of a landmark's neighbouring letters, one
        letter between them allowed, are 0 without a look."""
        out = np.zeros((len(rows), len(self.rows)), dtype=np.float32)
        pairs = _pairs(rows, (1, 2))
        near = [np.flatnonzero(np.bitwise_count(pairs & m).sum(1) > 0.5 * np.bitwise_count(m).sum()) for m in self.pairs]
        lengths = (rows > 0).sum(1)
        # A word's own kernel value is at least that of its runs of three characters, which rules most pairs out early.
        least = np.maximum(lengths - ORDER + 1, 1) * DECAY ** (2 * ORDER)
        for k, at in enumerate(near):
            for lo, hi in _LENGTHS:
                some = at[(lengths[at] > lo) & (lengths[at] <= hi)]
                if len(some):
                    out[some, k] = kernel(rows[some, :hi], self.rows[k])
            out[at[out[at, k] < ACTIVE * least[at] ** OWN * self.own[k] ** (1 - OWN)], k] = 0
        used = np.flatnonzero(out.any(1))
        for lo, hi in _LENGTHS:
            some = used[(lengths[used] > lo) & (lengths[used] <= hi)]
            if len(some):
                own = kernel(rows[some, :hi], rows[some, :hi])
                out[some] = np.minimum(1, out[some] / (own[:, None] ** OWN * np.array(self.own, dtype=np.float32) ** (1 - OWN)))
        out[out < ACTIVE] = 0
        return out ** POWER

    def documents(self, column: pa.Array) -> np.ndarray:
        """Per text the sum of its sentences' greatest kernel values, per ``WORDS`` words, square-rooted."""
        letters, start, end, row, sentence = tokens(column)
        out = np.zeros((len(column), len(self.rows)), dtype=np.float32)
        if not len(start):
            return out
        _, first, back = np.unique(span_hash(prefix_hash(letters), start, end), return_index=True, return_inverse=True)
        hits, hit_words = [np.zeros((0, len(self.rows)), np.float32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(first), WORDS_AT_ONCE):
            some = first[lo:lo + WORDS_AT_ONCE]
            parts, word = matrix(letters, start[some], end[some])
            values = self.words(parts)
            hit = np.flatnonzero(values.any(1))
            hits.append(values[hit])
            hit_words.append(word[hit] + lo)
        names, at = np.unique(np.concatenate(hit_words), return_inverse=True)
        by_word = np.zeros((len(names), len(self.rows)), dtype=np.float32)
        np.maximum.at(by_word, at, np.concatenate(hits))
        place = np.full(len(first), -1)
        place[names] = np.arange(len(names))
        use = np.flatnonzero(place[back] >= 0)
        key, at = np.unique(sentence[use], return_inverse=True)
        greatest = np.zeros((len(key), len(self.rows)), dtype=np.float32)
        np.maximum.at(greatest, at, by_word[place[back[use]]])
        rows = np.zeros(len(key), np.int64)
        rows[at] = row[use]
        np.add.at(out, rows, greatest)
        return np.sqrt(out / (1 + np.bincount(row, minlength=len(column))[:, None] / WORDS))

    def margins(self, column: pa.Array) -> np.ndarray:
        return self.documents(column) @ self.weights + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(column) + self.shift, -30, 30)))


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct character sequences per row: row, hash, place, and the fenced words they are read from (a place is start * 8 + length)."""
    letters, start, end, row, _ = tokens(column)
    size = end - start + 2
    first = np.cumsum(size) - size
    fenced = np.full(int(size.sum()), 36, dtype=np.uint8)
    inside = np.arange(len(fenced)) - np.repeat(first, size)
    middle = (inside > 0) & (inside < np.repeat(size, size) - 1)
    fenced[first] = 94
    fenced[middle] = letters[(np.repeat(start, size) + inside - 1)[middle]]
    sums, left, owner = prefix_hash(fenced), np.repeat(size, size) - inside, np.repeat(row, size)
    out = []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = span_hash(sums, at, at + n)
        _, some = np.unique(h ^ mix(owner[at].astype(np.uint64) + np.uint64(1)), return_index=True)
        out.append((owner[at[some]], h[some], at[some] * 8 + n))
    return *(np.concatenate(c) for c in zip(*out)), fenced


def chunks(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """The texts as columns of about ``size`` characters, each with the number of its first text."""
    start = spent = 0
    for k, text in enumerate(texts):
        spent += len(text or "")
        if spent >= size or k + 1 == len(texts):
            yield start, pa.array(texts[start:k + 1], pa.string())
            start, spent = k + 1, 0


def choose_landmarks(texts: list[str | None], labels: np.ndarray) -> list[bytes]:
    """Character sequences of toxic documents, by documents covered and not yet covered times the log ratio of their shares."""
    toxic, clean = [t for t, y in zip(texts, labels) if y == 1], [t for t, y in zip(texts, labels) if y == 0]
    found = [(k, start, _grams(column)) for k, (start, column) in enumerate(chunks(toxic))]
    hashes, first, count = np.unique(np.concatenate([g[1] for _, _, g in found]), return_index=True, return_counts=True)
    some = count >= max(3, SUPPORT * len(toxic))
    hashes, first, count = hashes[some], first[some], count[some]
    if not len(hashes):
        return []
    other = np.zeros(len(hashes), np.int64)
    for _, column in chunks(clean):
        h = _grams(column)[1]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        np.add.at(other, at[hashes[at] == h], 1)
    gain = np.log((count + 0.5) / (len(toxic) + 1)) - np.log((other + 0.5) / (len(clean) + 1))
    pool = np.flatnonzero(gain > math.log(4))
    pool = np.sort(pool[np.argsort(-(gain * count)[pool], kind="stable")][:4000])
    if not len(pool):
        return []
    cover = np.zeros((len(pool), len(toxic)), dtype=np.float32)
    names, base = [b""] * len(pool), 0
    for _, start, (row, h, place, fenced) in found:
        at = np.minimum(np.searchsorted(hashes[pool], h), len(pool) - 1)
        hit = np.flatnonzero(hashes[pool][at] == h)
        cover[at[hit], row[hit] + start] = 1
        for k in np.flatnonzero((first[pool] >= base) & (first[pool] < base + len(h))):
            p = int(place[first[pool[k]] - base])
            names[k] = fenced[p >> 3:(p >> 3) + (p & 7)].tobytes()
        base += len(h)
    worth = gain[pool] * np.array([1 + 0.1 * len(g) for g in names])  # of sequences with the same documents the longest says most
    weight, chosen = np.ones(len(toxic), dtype=np.float32), []
    for _ in range(min(LANDMARKS, len(pool))):
        k = int(np.argmax((cover @ weight) * worth))
        chosen.append(names[k])
        weight *= np.where(cover[k] > 0, 0.5, 1)
        worth[[n in names[k] or names[k] in n for n in names]] *= 0.2  # its own parts and extensions say little more
        worth[k] = 0
    return chosen


def _machine(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss and balanced classes, by accelerated gradient steps."""
    x1 = np.hstack((x, np.ones((len(x), 1))))
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    step = 1 / (2 * np.linalg.eigvalsh((x1 * share[:, None]).T @ x1)[-1] + ridge)
    w = v = np.zeros(x1.shape[1])
    for k in range(rounds):
        loss = np.maximum(0, 1 - y * (x1 @ v))
        grad = -2 * x1.T @ (share * y * loss) + ridge * np.append(v[:-1], 0)
        new = v - step * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve for classes of equal weight; targets are kept off 0 and 1 as usual for separable data."""
    share = np.where(y > 0, 0.5 * len(y) / max((y > 0).sum(), 1), 0.5 * len(y) / max((y < 0).sum(), 1))
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, r = share * (p - target), share * p * (1 - p) + 1e-9
        h = np.array([[(r * m * m).sum() + 1e-3, (r * m).sum()], [(r * m).sum(), r.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * m).sum() + 1e-3 * a, g.sum()])
        a, b = float(np.clip(a - da, 0, 50)), float(np.clip(b - db, -50, 50))
    return a, b


def fit(texts: list[str | None], labels: list[int]) -> Model:
    y = np.asarray(labels)
    share = float(y.mean()) if len(y) else 0.5
    flat = Model([], np.zeros(0), 0.0, 0.0, math.log((share + 1e-6) / (1 - share + 1e-6)))
    marks = choose_landmarks(texts, y) if len(y) and 0 < share < 1 else []
    if not marks:
        return flat
    model = Model(marks, np.zeros(len(marks)), 0.0, 1.0, 0.0)
    pad = np.zeros((len(marks), max(map(len, marks))), dtype=np.uint8)
    for k, mark in enumerate(marks):
        pad[k, :len(mark)] = np.frombuffer(mark, dtype=np.uint8)
    gram = np.stack([kernel(np.repeat(pad[k:k + 1], len(marks), 0), pad) for k in range(len(marks))]) / np.sqrt(np.outer(model.own, model.own))
    gram = gram ** POWER
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    x, side = np.vstack([model.documents(column) for _, column in chunks(texts)]), np.where(y == 1, 1, -1)
    w, model.bias = _machine(x @ root, side)
    model.weights = root @ w
    model.slope, model.shift = _logistic(x @ model.weights + model.bias, side)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, column: str, keep, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> tuple[list, list]:
    """Texts and labels of a bounded sample: per class the ``rows`` labelled documents of least id hash, at most ``size`` bytes in all."""
    known = labels.where(keep & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).alias("_y"))
    spread = F.xxhash64("doc_id")
    picked = [known.where(F.col("_y") == k).orderBy(spread, "doc_id").limit(rows) for k in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 x rows ids
    own = docs.select("doc_id", "text").join(ids, "doc_id")
    lengths = own.select("doc_id", "_y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), spread.alias("h")).orderBy("h", "doc_id").limit(4 * rows).collect()
    taken, spent = set(), {0: 0, 1: 0}
    for r in lengths:
        if spent[r["_y"]] + r["n"] <= size // 2:
            spent[r["_y"]] += r["n"]
            taken.add(r["doc_id"])
    if not taken:
        return [], []
    got = sorted(own.where(F.col("doc_id").isin(sorted(taken))).select("doc_id", "text", "_y").limit(4 * rows).collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    return [r["text"] for r in got], [r["_y"] for r in got]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the labelled documents outside the held-out third."""
    return fit(*training_rows(docs, labels, "toxic", fold(3) != 1))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the toxicity of every whole text, 0 to 1; an own column of that name is replaced."""
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
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score ``THRESHOLD`` or more."""
    name = fresh(docs, "_toxicity")[0]
    return score(docs, train(docs, labels), name).where(F.col(name) < THRESHOLD).drop(name)
