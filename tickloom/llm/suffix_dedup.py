"""Removal of repeated substrings with difference-cover samples and suffix buckets.

Texts are UTF-8 bytes.  A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier (smaller doc_id, or earlier in the
same document); strings never cross documents.  Only suffixes whose first ``LENGTH`` bytes may occur twice need sorting:

1. Documents are stored in blocks (compressed, a few megabytes, sorted by doc_id), bucketed by the task that wrote them, so later passes
   meet what was found out about a block without moving its text.
2. Content-defined chunks: a chunk is the bytes up to the next cut and the ``LENGTH`` - 1 after it, so equal chunks have equal suffixes.
   All suffixes of a chunk that stands earlier elsewhere are repeats at once; only first chunks go on.
3. Cover sample: positions whose offset modulo ``PERIOD`` is in a perfect difference set, so any two suffixes have a sampled position at
   one common distance below ``PERIOD``.  Samples get the name of their next ``SAMPLE`` = LENGTH - PERIOD + 1 bytes; suffixes without a
   repeated name within that distance are unique and drop out.
4. The other suffixes are named by their ``LENGTH`` bytes, dealt to buckets of names, and one bucket is sorted at a time.

Only equality of prefixes matters, so names are hashes (64 bits) and buckets are ranges of hashes, not of characters.  In every step a
block merges equal names before they are dealt, so the hottest name reaches its bucket once per block, and a bucket answers with one bit
per name and block.  All steps cover all bytes; memory is bounded by a block and by a bucket, whose number grows with the text.

Null and empty texts have 0 bytes; texts under ``LENGTH`` bytes lose nothing; rows that repeat a doc_id count as documents of their own in
the order of their blocks; rows without doc_id come last; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.text import bounded, prefix_hash, runs, shared_folder, slices, span_hash, stored, utf8

LENGTH = 100
# A perfect difference set; every non-zero distance modulo 73 is the difference of exactly one pair.
PERIOD, COVER = 73, (0, 1, 12, 20, 26, 30, 33, 35, 57)
SAMPLE = LENGTH - PERIOD + 1
CUT = 8  # bytes that decide a cut; one position in 64 is one
BUCKET_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20
_LAST = np.iinfo(np.int64).max


class Block:
    """The bytes of a block's documents end to end, in the order of doc_id."""

    def __init__(self, blob: bytes, sizes: bytes, ids: bytes):
        self.raw = np.frombuffer(zstandard.decompress(blob) if blob else b"", dtype=np.uint8)
        self.bounds = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, dtype=np.int64))))
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.sums = prefix_hash(self.raw)
        size, narrow = np.diff(self.bounds), self.bounds.astype(np.min_scalar_type(-int(self.bounds[-1]) - 1))
        self.stop = np.repeat(narrow[1:], size)  # end of each byte's document
        self.start = np.repeat(narrow[:-1], size)

    def names(self, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of spans in ascending order, the first span of each, and each span's name."""
        h = span_hash(self.sums, at, end)
        order = np.argsort(h)
        h = h[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        inverse = np.empty(len(h), np.int32)
        inverse[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        return h[new], np.minimum.reduceat(order, np.flatnonzero(new)) if len(h) else order, inverse

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Ids of the documents that positions lie in."""
        return self.ids[np.searchsorted(self.bounds, at, side="right") - 1]

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end of its suffixes, and end of its bytes, for each chunk that has suffixes."""
        n = len(self.raw)
        if n < LENGTH:
            return (np.zeros(0, np.int64),) * 3
        eight = np.ndarray((n - CUT + 1,), dtype="<u8", buffer=self.raw, strides=(1,))
        cut = np.zeros(n, dtype=bool)
        cut[:n - CUT + 1] = ((eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)) == 0
        cut[n - LENGTH + 1:] = False
        cut &= np.arange(n, dtype=self.stop.dtype) <= self.stop - LENGTH  # a cut is a suffix of full length
        cut[self.bounds[:-1][np.diff(self.bounds) >= LENGTH]] = True
        start = np.flatnonzero(cut)
        after = np.minimum(np.append(start[1:], n), self.stop[start] - LENGTH + 1)
        return start, after, np.minimum(after + LENGTH - 1, self.stop[start])

    def samples(self, live: np.ndarray) -> np.ndarray:
        """Cover positions within reach of a live suffix."""
        cover = np.zeros(PERIOD, dtype=bool)
        cover[list(COVER)] = True
        n = len(self.raw)
        reach = np.zeros(n + PERIOD + 1, np.int32)
        starts, ends = runs(live)
        np.add.at(reach, starts, 1)
        np.add.at(reach, ends + PERIOD - 1, -1)
        at = np.flatnonzero(np.cumsum(reach, dtype=np.int32)[:n] > 0)
        return at[cover[(at - self.start[at]) % PERIOD] & (at + SAMPLE <= self.stop[at])]


class State:
    """What is known about a block after each answer.  A question sets ``asked``: names, first spans, each span's name, and positions."""

    def __init__(self, block: Block):
        self.block = block
        self.chunk = block.chunks()

    def _early(self, early: np.ndarray) -> np.ndarray:
        """Which of the spans asked about have an equal one before them, here or, by the answer, elsewhere."""
        _, first, inverse, _ = self.asked
        gone = np.ones(len(inverse), bool)
        gone[first] = early
        return gone

    def first(self) -> None:
        start, _, end = self.chunk
        self.asked = *self.block.names(start, end), start

    def live(self, early: np.ndarray) -> None:
        """After chunks are judged: which suffixes are repeats already, and which stay open."""
        start, after, _ = self.chunk
        gone = self._early(early)
        n = len(self.block.raw)
        self.repeat, self.open = np.zeros(n, bool), np.zeros(n, bool)
        for flags, which in ((self.repeat, gone), (self.open, ~gone)):
            step = np.zeros(n + 1, np.int32)
            np.add.at(step, start[which], 1)
            np.add.at(step, after[which], -1)
            flags[:] = np.cumsum(step, dtype=np.int32)[:n] > 0

    def second(self) -> None:
        at = self.block.samples(self.open)
        self.asked = *self.block.names(at, at + SAMPLE), at

    def narrow(self, often: np.ndarray) -> None:
        """After samples are judged: open suffixes keep a repeated name within reach."""
        names, _, inverse, at = self.asked
        twice = often | (np.bincount(inverse, minlength=len(names)) > 1)
        at = at[twice[inverse]]
        n = len(self.block.raw)
        reach = np.zeros(n + 1, np.int32)
        np.add.at(reach, np.maximum(at - PERIOD + 1, 0), 1)
        np.add.at(reach, at + 1, -1)
        self.open &= np.cumsum(reach, dtype=np.int32)[:n] > 0

    def third(self) -> None:
        at = np.flatnonzero(self.open)
        self.asked = *self.block.names(at, at + LENGTH), at

    def finish(self, early: np.ndarray) -> None:
        self.repeat[self.asked[3][self._early(early)]] = True

    def removed(self) -> np.ndarray:
        n = len(self.block.raw)
        step = np.zeros(n + 1, np.int32)
        at, end = runs(self.repeat)
        np.add.at(step, at, 1)
        np.add.at(step, end + LENGTH - 1, -1)
        return np.cumsum(step, dtype=np.int32)[:n] > 0


def _write_blocks(docs: DataFrame) -> DataFrame:
    """The documents as a table of blocks, bucketed by ``part`` so that answers are joined to it in place."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for piece in slices(batch, limit=BLOCK_BYTES):
                ids = np.asarray(pa.compute.fill_null(piece.column("doc_id"), _LAST), dtype=np.int64)
                order = np.argsort(ids, kind="stable")
                known = pa.compute.is_valid(piece.column("doc_id")).take(pa.array(order))
                raw, bounds = utf8(piece.column("text").take(pa.array(order)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([pack.compress(raw.tobytes())], pa.binary()),
                     pa.array([np.diff(bounds).astype(np.int64).tobytes()], pa.binary()), pa.array([ids[order].tobytes()], pa.binary()),
                     pa.array([np.asarray(known.cast(pa.uint8())).tobytes()], pa.binary())],
                    names=["part", "block", "blob", "sizes", "ids", "known"])
                block += 1

    spark = docs.sparkSession
    blocks = bounded(docs.select("doc_id", "text")).mapInArrow(task, "part int, block int, blob binary, sizes binary, ids binary, known binary")
    name = f"blocks_{uuid.uuid4().hex}"
    tasks = docs.rdd.getNumPartitions()
    path = f"{shared_folder(spark)}/{name}"
    blocks.write.bucketBy(max(1, min(2 * tasks, 50_000)), "part").sortBy("part").option("path", path).saveAsTable(name)
    return spark.table(name)


def _emit(step: int, answers: list[str], buckets: int):
    """A task that names what step 1, 2 or 3 asks for, merged per block and dealt to buckets of names."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                state = _state(row, answers)
                (state.first, state.second, state.third)[step]()
                names, first, _, at = state.asked
                ids = state.block.owner(at[first]) if step != 1 else first
                bucket = ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                which, start = np.unique(bucket, return_index=True)
                out = []
                for b, s, e in zip(which.tolist(), start.tolist(), [*start[1:].tolist(), len(names)]):
                    low, own = names[s:e], ids[s:e]
                    if step == 1:  # order does not matter, and 40 bits beside the bucket do for a filter
                        out.append((b, row["part"], row["block"], low.view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), 0, b""))
                    else:
                        least = int(own.min())
                        narrow = (own - least).astype(np.min_scalar_type(int(own.max()) - least))
                        out.append((b, row["part"], row["block"], low.tobytes(), least, narrow.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _DEALT)], names=["bucket", "part", "block", "names", "base", "ids"])

    return task


_DEALT = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary())


def _state(row: dict, answers: list[str]) -> State:
    state = State(Block(row["blob"], row["sizes"], row["ids"]))
    for column, (ask, take) in zip(answers, ((state.first, state.live), (state.second, state.narrow), (state.third, state.finish))):
        ask()
        names = state.asked[0]
        flags = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in sorted(row[column] or [], key=lambda x: x["bucket"])]
        flags = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
        if len(flags) != len(names):
            raise ValueError(f"block {row['part']}/{row['block']}: {len(flags)} answers for {len(names)} names")
        take(flags)
    return state


def _resolve(step: int):
    """A task that sorts one bucket at a time and answers each block: is an equal name earlier elsewhere (step 2: anywhere else)?"""
    def solve(rows: list[dict]) -> list[tuple]:
        width = 5 if step == 1 else 8
        count = [len(r["names"]) // width for r in rows]
        if step == 1:
            names = np.zeros((sum(count), 8), np.uint8)
            names[:, :5] = np.frombuffer(b"".join(r["names"] for r in rows), np.uint8).reshape(-1, 5)
            names = names.view(np.uint64).ravel()
            order = np.argsort(names, kind="stable")
        else:
            names = np.frombuffer(b"".join(r["names"] for r in rows), np.uint64)
            ids = np.concatenate([np.frombuffer(r["ids"], f"u{len(r['ids']) // n}").astype(np.int64) + r["base"] for r, n in zip(rows, count)])
            order = np.lexsort((ids, names))  # equal ids: the order of parts and blocks, in which rows come
        same = names[order][1:] == names[order][:-1]
        flag = np.zeros(len(names), bool)
        flag[order[1:][same]] = True
        if step == 1:
            flag[order[:-1][same]] = True
        ends = np.cumsum(count)
        return [(r["part"], r["block"], r["bucket"], n, np.packbits(flag[e - n:e]).tobytes()) for r, n, e in zip(rows, count, ends.tolist())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["bucket"] != rows[0]["bucket"]:
                    yield _answers(solve(rows))
                    rows = []
                rows.append(row)
        if rows:
            yield _answers(solve(rows))

    return task


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["part", "block", "bucket", "n", "bits"])


def _known(blocks: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Blocks with the answers so far, each block's own; the text stays where it is."""
    out = blocks
    for k, answer in enumerate(found):
        out = out.join(answer.withColumnRenamed("answer", f"all{k}"), "part", "left").withColumn(
            f"a{k}", F.filter(f"all{k}", lambda x: x["block"] == F.col("block"))).drop(f"all{k}")
    return out


def mark(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, list[str]]:
    """The blocks with all three answers, and the answers' names."""
    blocks = _write_blocks(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(128, int(size // bucket_bytes))
    found: list[DataFrame] = []
    for step in range(3):
        names = [f"a{k}" for k in range(step)]
        dealt = _known(blocks, found).select("part", "block", "blob", "sizes", "ids", *names).mapInArrow(
            _emit(step, names, buckets), "bucket long, part int, block int, names binary, base long, ids binary")
        answers = dealt.repartition("bucket").sortWithinPartitions("bucket", "part", "block").mapInArrow(
            _resolve(step), "part int, block int, bucket long, n long, bits binary")
        found.append(stored(answers.groupBy("part").agg(F.collect_list(F.struct("block", "bucket", "n", "bits")).alias("answer")), f"answer{step}"))
    return _known(blocks, found), [f"a{k}" for k in range(3)]


def _apply(docs: DataFrame, row: Callable, kinds: tuple, names: list[str], schema: str, bucket_bytes: int) -> DataFrame:
    marked, answers = mark(docs, bucket_bytes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                state = _state(r, answers)
                gone, b, known = state.removed(), state.block.bounds, np.frombuffer(r["known"], np.uint8)
                rows = [(int(state.block.ids[k]) if known[k] else None, *row(state.block.raw[b[k]:b[k + 1]], gone[b[k]:b[k + 1]])) for k in range(len(known))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return marked.mapInArrow(task, schema)


def report(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256."""
    def row(raw: np.ndarray, gone: np.ndarray) -> tuple:
        return len(raw), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(raw[~gone].tobytes()).hexdigest()

    return _apply(docs, row, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                  "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", bucket_bytes)


def deduplicate(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document its removed spans (byte offsets) and its remaining bytes, which need not be valid UTF-8 where a character was cut."""
    def row(raw: np.ndarray, gone: np.ndarray) -> tuple:
        return [{"start": s, "end": e} for s, e in zip(*(x.tolist() for x in runs(gone)))], raw[~gone].tobytes()

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return _apply(docs, row, (pa.int64(), span, pa.binary()), ["doc_id", "removed", "kept"],
                  "doc_id long, removed array<struct<start: long, end: long>>, kept binary", bucket_bytes)
