"""Benchmark decontamination with suffix arrays of the training words.

Each slice of documents is a shard.  Its suffix array holds every word position from which a run of benchmark words is long enough for a
window, in the order of the words that follow; other suffixes cannot start a match.  Every test suffix (the windows of all items) is
binary-searched in it, which yields all places where it stands; neighbouring windows on one diagonal are one verbatim match.

A window is 13 consecutive words of an item; an item with fewer words, but not none, is one window.  A document word inside an occurrence
of a window is hit.  Null or wordless documents have 0 words and are clean; null or wordless items match nothing; repeated items (same or
different ids) each count; repeated documents are judged row by row; other columns, whatever their names, pass through ``decontaminate``.

The windows are broadcast in parts of at most ``PART_BYTES`` of benchmark text, so a task never holds more than one part's index.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.llm.text import bounded, fresh, runs, slices, stored, words

WINDOW = 13
PART_BYTES = 16 << 20
_KEY = f"S{4 * WINDOW}"


class Windows:
    """The distinct windows of some items: their words as ids, and which items hold them where."""

    def __init__(self, items: list[tuple[str, str | None]]):
        ids = [i for i, _ in items]
        hashes, bounds = words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        codes = codes.astype(np.uint32) + 1
        found: dict[bytes, list[tuple[int, int]]] = {}
        for k in range(len(ids)):
            own = codes[bounds[k]:bounds[k + 1]].astype(">u4")
            for at in range(max(1, len(own) - WINDOW + 1) if len(own) else 0):
                found.setdefault(own[at:at + WINDOW].tobytes(), []).append((k, at))
        self.ids, self.sizes = ids, np.array([len(k) // 4 for k in found], dtype=np.int64)
        self.owners = list(found.values())
        self.low = np.array([k.ljust(4 * WINDOW, b"\0") for k in found], dtype=_KEY)
        self.high = np.array([k.ljust(4 * WINDOW, b"\xff") for k in found], dtype=_KEY)
        self.shortest = int(self.sizes.min()) if found else 0

    def suffix_array(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the shard's suffixes that can start a window, in suffix order, and their sorted keys."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        codes = np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)
        stop = codes == 0
        ends = np.unique(np.concatenate((np.flatnonzero(stop), bounds)))
        live = np.flatnonzero(~stop)
        room = ends[np.searchsorted(ends, live, side="right")] - live
        live, room = live[room >= self.shortest], room[room >= self.shortest]
        step = np.arange(WINDOW)
        padded = np.concatenate((codes, np.zeros(WINDOW, np.uint32)))
        keys = np.where(step < room[:, None], padded[live[:, None] + step], 0).astype(">u4")
        keys = np.ascontiguousarray(keys).view(_KEY).ravel()
        order = np.argsort(keys, kind="stable")
        return live[order], keys[order]

    def search(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences (word position in the slice, window number), and the slice's row bounds in words."""
        hashes, bounds = words(column)
        if not self.shortest or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), bounds
        suffixes, keys = self.suffix_array(hashes, bounds)
        first, last = np.searchsorted(keys, self.low), np.searchsorted(keys, self.high, side="right")
        count = last - first
        window = np.repeat(np.arange(len(count)), count)
        at = suffixes[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        return at, window, bounds


def _parts(benchmark: DataFrame, part_bytes: int) -> tuple[int, Iterator[list[tuple[str, str | None]]]]:
    """How many parts of bounded size the items make, and the parts, one on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("item_id").isNotNull())
    n = int((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, ([tuple(r) for r in (items if n == 1 else items.where(part == k)).collect()] for k in range(n))


def scan(docs: DataFrame, benchmark: DataFrame, finish: Callable, schema: T.StructType, part_bytes: int = PART_BYTES) -> DataFrame:
    """What ``finish`` makes of each batch of ``docs``, given its packed runs of hit words, the ids of the occurring items (as sorted
    strings) and its numbers of words, once all items are searched for."""
    spark, plain = docs.sparkSession, docs.columns
    added = fresh(docs, "_hits", "_items")
    between = T.StructType(docs.schema.fields + [T.StructField(added[0], T.BinaryType()), T.StructField(added[1], T.ArrayType(T.StringType()))])
    out = bounded(docs)
    n, parts = _parts(benchmark, part_bytes)
    for k, items in enumerate(parts):
        shared = spark.sparkContext.broadcast(items)

        def task(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0, last=k + 1 == n) -> Iterator[pa.RecordBatch]:
            windows = Windows(shared.value)
            for batch in batches:
                for piece in slices(batch):
                    at, window, bounds = windows.search(piece.column("text"))
                    size = piece.num_rows
                    before = ([b""] * size, [[] for _ in range(size)]) if first else (piece.column(c).to_pylist() for c in added)
                    hits, found = _per_row(windows, at, window, bounds, *before)
                    own = piece.select(plain)
                    yield finish(own, hits, found, np.diff(bounds).tolist()) if last else pa.RecordBatch.from_arrays(
                        [*own.columns, pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.string()))], names=plain + added)

        out = out.mapInArrow(task, schema if k + 1 == n else between)
        if k + 1 < n:
            out = stored(out, "decontaminate")  # a stage then holds one part only
    return out


def _per_row(windows: Windows, at, window, bounds, hits: list[bytes], found: list[list[str]]) -> tuple[list[bytes], list[list[str]]]:
    """Per row the packed hit runs and the sorted item ids, added to those of earlier parts."""
    row = np.searchsorted(bounds, at, side="right") - 1
    cover = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + windows.sizes[window], -1)
    covered = np.cumsum(cover[:-1]) > 0
    for r in np.unique(row):
        starts, ends = runs(covered[bounds[r]:bounds[r + 1]])
        hits[r] += b"".join(struct.pack("<qq", s, e) for s, e in zip(starts.tolist(), ends.tolist()))
    pair = np.unique(np.stack((row, window), 1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
    for r, w in pair.tolist():
        found[r] = found[r] + [windows.ids[k] for k, _ in windows.owners[w]]
    return hits, [sorted(set(x)) if x else [] for x in found]


def _hit_words(packed: bytes) -> int:
    total = end = 0
    for s, e in sorted(struct.iter_unpack("<qq", packed)):
        total += max(0, e - max(s, end))
        end = max(end, e)
    return total


def _contaminated(hit: int, words: int) -> bool:
    return hit > 0 and 20 * hit >= words


def judge(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document its doc_id, n_words, n_hit, n_items, items_sha256 and whether it is contaminated."""
    def finish(own: pa.RecordBatch, hits: list[bytes], items: list[list[str]], n_words: list[int]) -> pa.RecordBatch:
        n_hit = [_hit_words(x) for x in hits]
        return pa.RecordBatch.from_arrays(
            [own.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
             pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
             pa.array([_contaminated(h, n) for h, n in zip(n_hit, n_words)], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kinds = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(), "contaminated": T.BooleanType()}
    plain = docs.select("doc_id", "text")
    schema = T.StructType([plain.schema["doc_id"], *(T.StructField(c, t) for c, t in kinds.items())])
    return scan(plain, benchmark, finish, schema, part_bytes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` without the contaminated rows: at least one hit word, and at least a twentieth of the words hit."""
    def finish(own: pa.RecordBatch, hits: list[bytes], items: list[list[str]], n_words: list[int]) -> pa.RecordBatch:
        return own.filter(pa.array([not _contaminated(_hit_words(x), n) for x, n in zip(hits, n_words)], pa.bool_()))

    return scan(docs, benchmark, finish, docs.schema, part_bytes)


def matches(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The longest verbatim matches: (doc_id, item_id, doc_word, item_word, n_words), one row per maximal diagonal run of windows."""
    spark, parts = docs.sparkSession, []
    for items in _parts(benchmark, part_bytes)[1]:
        shared = spark.sparkContext.broadcast(items)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = Windows(shared.value)
            for batch in batches:
                for piece in slices(batch):
                    at, window, bounds = windows.search(piece.column("text"))
                    doc, rows = piece.column("doc_id").to_pylist(), []
                    row = np.searchsorted(bounds, at, side="right") - 1
                    spots = sorted((r, k, p - a, a, n) for p, w, r, n in zip(at.tolist(), window.tolist(), row.tolist(), windows.sizes[window].tolist())
                                   for k, a in windows.owners[w])
                    last = None
                    for r, k, diagonal, a, n in spots:
                        if last and last[:3] == [r, k, diagonal] and a <= last[4]:
                            last[4] = a + n
                        else:
                            last = [r, k, diagonal, a, a + n]
                            rows.append(last)
                    cols = zip(*[(doc[r], windows.ids[k], d + a - int(bounds[r]), a, e - a) for r, k, d, a, e in rows]) if rows else [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                                     names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        parts.append(bounded(docs.select("doc_id", "text")).mapInArrow(task, "doc_id long, item_id string, doc_word long, item_word long, n_words long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
