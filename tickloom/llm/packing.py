"""Order-preserving sequence packing by dynamic programming over cut points.

A task tokenizes its documents in the order of its partition, appends an end id to each, and cuts that stream into sequences of at most
``capacity`` tokens.  Cuts may fall at document ends (free), sentence ends (``sentence_cost``) or, where a sequence is full, anywhere
(``word_cost``); a sequence costs its padding besides.  With f(j) the least cost of a stream cut at j,

    f(j) = min over i in [j - capacity, j) of f(i) + i  +  capacity - j + cost(j),

so one monotone queue of the keys f(i) + i gives every transition in constant time.  A cut inside a sentence is worth taking only where the best
predecessor is about to leave the queue: it becomes the cut of a full sequence.  Work is done in stretches of ``STRETCH`` tokens; the last,
open sequence of a stretch is carried into the next, so memory does not depend on the partition.  There is no shuffle: only the last
sequence of a partition is padded for want of text.

A null or empty text is its end id alone; repeated rows are packed row by row; an empty table gives no rows; very long texts are cut
into as many pieces as they need.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.text import bounded

CAPACITY, SENTENCE_COST, WORD_COST = 1024, 4, 12
STRETCH = 1 << 18
END = 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Tokenizer:
    """Byte-level BPE ids.  The rank file gives the ids of the vocabulary file many times faster; texts that it cannot split go to the latter."""

    def __init__(self, name: str = "byte_bpe_50k", special: str = "<|endoftext|>"):
        import public_tokenizers
        import tiktoken

        self.vocabulary = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})
        self.whole = None
        self.ends = np.zeros(len(ranks) + 1, dtype=bool)
        self.ends[[rank for token, rank in ranks.items() if token[-1:] in (b".", b"!", b"?", b"\n")]] = True

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self.whole is None:
                from tokenizers import Tokenizer as Whole

                self.whole = Whole.from_file(self.vocabulary)
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def best_cuts(bounds: list[int], costs: list[float], capacity: int, word_cost: float) -> list[int]:
    """The cheapest cuts of a stream that ends at ``bounds[-1]``; bounds are increasing positions with their costs."""
    at, key, back = [0], [0.0], [-1]  # position, f + position, previous state
    queue = deque([0])  # states with increasing keys
    append, pop = queue.append, queue.pop
    for bound, extra in zip(bounds, costs):
        while at[queue[0]] + capacity < bound:
            full = queue.popleft()
            reached = key[full] + capacity + word_cost
            while queue and key[queue[-1]] >= reached:
                pop()
            append(len(at))
            at.append(at[full] + capacity)
            key.append(reached)
            back.append(full)
        source = queue[0]
        reached = key[source] + capacity + extra
        while queue and key[queue[-1]] >= reached:
            pop()
        append(len(at))
        at.append(bound)
        key.append(reached)
        back.append(source)
    state, cuts = len(at) - 1, []
    while state > 0:
        cuts.append(at[state])
        state = back[state]
    return cuts[::-1]


class Packer:
    def __init__(self, first_sequence: int, tokenizer: Tokenizer, capacity: int, sentence_cost: float, word_cost: float):
        self.next, self.tokenizer, self.capacity = first_sequence, tokenizer, capacity
        self.costs = sentence_cost, word_cost
        self.open: list[tuple[int, int, int, np.ndarray]] = []  # doc_id, ids before, ids of the document, ids
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> Iterator[tuple]:
        ids = np.append(self.tokenizer.ids(text or ""), np.uint32(END))
        for start in range(0, len(ids), STRETCH):
            part = ids[start:start + STRETCH]
            self.open.append((doc_id, start, len(ids), part))
            self.size += len(part)
            if self.size >= STRETCH:
                yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.open:
            return
        ids = np.concatenate([p[3] for p in self.open])
        firsts = np.concatenate(([0], np.cumsum([len(p[3]) for p in self.open])))
        ends = [f + len(p[3]) for f, p in zip(firsts.tolist(), self.open) if p[1] + len(p[3]) == p[2]]
        cost = np.full(len(ids) + 1, -1.0)
        cost[np.flatnonzero(self.tokenizer.ends[ids]) + 1] = self.costs[0]
        cost[ends] = 0
        cost[len(ids)] = max(cost[len(ids)], 0)
        bounds = np.flatnonzero(cost >= 0)
        cuts = best_cuts(bounds.tolist(), cost[bounds].tolist(), self.capacity, self.costs[1])
        if not last:
            cuts = cuts[:-1]
        done, k = 0, 0
        for cut in cuts:
            offset = 0
            while done < cut:
                doc_id, before, total, part = self.open[k]
                upto = min(cut, int(firsts[k + 1]))
                yield doc_id, before + done - int(firsts[k]), upto - done, ids[done:upto].tobytes(), total, self.next, offset
                offset, done = offset + upto - done, upto
                k += upto == firsts[k + 1]
            self.next += 1
        rest = [(d, b + max(0, done - int(f)), t, p[max(0, done - int(f)):]) for f, (d, b, t, p) in zip(firsts[k:], self.open[k:])]
        self.open, self.size = rest, len(ids) - done


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, sentence_cost: float = SENTENCE_COST,
         word_cost: float = WORD_COST) -> DataFrame:
    """Pieces of all documents: where they stand in their document and in which sequence, with their ids (32-bit, little-endian)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 33, Tokenizer(tokenizer), capacity, sentence_cost, word_cost)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)],
                                              names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                rows.extend(packer.add(doc_id.as_py(), text.as_py()))
                if len(rows) >= 2000:
                    yield out()
        rows.extend(packer.flush(True))
        if rows:
            yield out()

    return bounded(docs.select("doc_id", "text")).mapInArrow(task, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids instead of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
