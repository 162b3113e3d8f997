"""N-gram Jaccard self-join: MinHash bands propose, full n-gram sets decide.

1. Each text becomes the set of its ``N``-word shingles (words lower-cased in ASCII).  Texts with equal sets are one class of copies, kept
   as a number of its own with its least doc_id and the number of copies.
2. Classes get ``BANDS`` x ``ROWS`` minima; bands and rows are chosen by ``plan_bands`` so that a pair at the threshold shares a band with
   at least the target recall (0.9999 at 0.8).  Classes are shuffled on their band hashes; buckets of one are dropped.
3. A bucket is compared in blocks of ``BLOCK`` classes: each pair of blocks is one unit of work, so a hot bucket is many tasks.  A unit
   compares one byte of each minimum and reports a spanning forest of the pairs that could reach the threshold, never the pairs.
4. Connected components of those edges are the candidate groups.  They are compared again in blocks, now on full shingle sets: a unit
   reports per class how many documents it links to, and a spanning forest of the true links, whose components are the result's classes.

All pairs within a candidate group are decided exactly.  Texts with fewer than ``N`` words, but not none, have one shingle of all their
words.  Texts without words (null and empty ones among them) link to nothing.  Rows that repeat a text count as copies, whatever their
doc_id; a doc_id may name several texts, each of which is in its own class.  Rows without doc_id are left out; an empty table gives no
rows; extra columns are ignored by ``link`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.components import components
from tickloom.llm.text import bounded, fresh, mix, slices, stored, words

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
ROWS = 5
BLOCK = 256
_ODD = np.random.default_rng(7).integers(1, 1 << 31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = np.random.default_rng(11).integers(0, 1 << 32, 4096, dtype=np.uint32)


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` minima after which a pair at the threshold is missed with probability 1 - ``recall`` at most."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a column in order (with repeats), and the n + 1 bounds of its rows in shingles."""
    hashes, bounds = words(column)
    size = np.diff(bounds)
    count = np.where(size >= N, size - N + 1, np.minimum(size, 1))
    out_bounds = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], count) + np.repeat(bounds[:-1], count)
    left = np.repeat(size, count)
    total = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate((hashes, np.zeros(N, np.uint64)))
    for k in range(N):
        part = mix(padded[at + k] + np.uint64(k + 1))
        total = mix(total + (part if k == 0 else np.where(left > k, part, np.uint64(0))))
    return total, out_bounds


def digest(grams: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums over a set of distinct hashes."""
    return grams.sum(), mix(grams ^ np.uint64(0x5BD1E995)).sum()


def signatures(docs: DataFrame, bands: int) -> DataFrame:
    """The columns of ``docs`` but for its text, two halves of the set's digest (NULL without words), band hashes, and the low byte of
    each minimum."""
    own = [c for c in docs.columns if c != "text"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                h, bounds = shingles(piece.column("text"))
                full = np.flatnonzero(np.diff(bounds))
                low = (h >> np.uint64(32)).astype(np.uint32)
                minima = np.zeros((len(full), bands * ROWS), dtype=np.uint32)
                for k in range(bands * ROWS if len(full) else 0):
                    minima[:, k] = np.minimum.reduceat((low ^ _XOR[k]) * _ODD[k], bounds[full])
                band = np.zeros((len(full), bands), dtype=np.uint64)
                for r in range(ROWS):
                    band = mix(band + minima[:, r::ROWS].astype(np.uint64) + np.uint64(r + 1))
                keys = np.zeros((len(full), 2), dtype=np.uint64)
                for i, d in enumerate(full):
                    keys[i] = digest(np.unique(h[bounds[d]:bounds[d + 1]]))
                signed = keys.view(np.int64)
                lists: list = [[None] * len(piece) for _ in range(4)]
                octets = (minima >> np.uint32(7)).astype(np.uint8)
                for i, d in enumerate(full.tolist()):
                    lists[0][d], lists[1][d], lists[2][d], lists[3][d] = signed[i, 0], signed[i, 1], band[i].view(np.int64), octets[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in own), pa.array(lists[0], pa.int64()), pa.array(lists[1], pa.int64()),
                     pa.array(lists[2], pa.list_(pa.int64())), pa.array(lists[3], pa.binary())], names=[*own, "k1", "k2", "bands", "octets"])

    return bounded(docs.where(F.col("doc_id").isNotNull())).mapInArrow(
        task, "".join(f"{c} long, " for c in own) + "k1 long, k2 long, bands array<long>, octets binary")


def _units(members: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Members dealt to pairs of blocks of their group: one row for each unit of work, marked with the block it brings."""
    blocks = F.ceil(F.col(count) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(3)), blocks).cast("int")
    with_own = members.withColumns({"_n": blocks, "own": own})
    spread = with_own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    unit = spread.withColumns({"i": F.least("own", "_o"), "j": F.greatest("own", "_o")}).drop("_n", "_o", count)
    deal = [*keys, "i", "j"]
    return unit.repartition(*deal).sortWithinPartitions(*deal, "rep")


def _each_unit(keys: list[str], work: Callable[[pa.Table], list[tuple]], schema: pa.Schema):
    """A task over rows sorted by unit that hands whole units to ``work``; only the open unit is kept between batches."""
    deal = [*keys, "i", "j"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_part: list[pa.RecordBatch] = []
        open_key = None
        rows: list[tuple] = []
        for batch in batches:
            marks = [np.asarray(batch.column(c)) for c in deal]
            change = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            for s, e in zip(bounds[:-1], bounds[1:]):
                if s == e:
                    continue
                key = tuple(int(m[s]) for m in marks)
                if key != open_key:
                    if open_part:
                        rows += work(pa.Table.from_batches(open_part))
                    open_part, open_key = [], key
                open_part.append(batch.slice(s, e - s))
                if len(rows) > 5000:
                    yield _batch(rows, schema)
                    rows = []
        if open_part:
            rows += work(pa.Table.from_batches(open_part))
        if rows:
            yield _batch(rows, schema)

    return task


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _forest(ids: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """(member, root) for all members tied to another; ``near`` is a symmetric matrix, ids ascend, so roots are least ids."""
    left, out = near.any(1), []
    while left.any():
        root = int(np.argmax(left))
        group = front = np.arange(len(ids)) == root
        while front.any():
            front = near[front].any(0) & ~group
            group = group | front
        out += [(int(ids[k]), int(ids[root])) for k in np.flatnonzero(group & (np.arange(len(ids)) != root))]
        left &= ~group
    return out


def _crossed(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs a unit has to compare: all within its only block, or those between its two blocks."""
    own = np.asarray(part.column("own"))
    if part.column("i")[0] == part.column("j")[0]:
        return own, ~np.eye(len(own), dtype=bool)
    return own, own[:, None] != own[None, :]


def candidates(sets: DataFrame, threshold: float, bands: int) -> DataFrame:
    """Edges (a, b) of a spanning forest over the pairs of classes (rep, bands, octets) that may reach the threshold."""
    hashed = sets.select("rep", F.posexplode("bands").alias("band", "hash"))
    shared = hashed.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = hashed.join(shared, ["band", "hash"]).join(sets.select("rep", "octets"), "rep")
    n = bands * ROWS
    # Five standard deviations of the share of equal minima below the threshold.
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / n)

    def work(part: pa.Table) -> list[tuple]:
        if len(part) < 2:
            return []
        ids = np.asarray(part.column("rep"))
        octets = np.frombuffer(b"".join(part.column("octets").to_pylist()), dtype=np.uint8).reshape(len(ids), n)
        _, cross = _crossed(part)
        near = np.zeros((len(ids), len(ids)), dtype=bool)
        for k in range(0, len(ids), 64):
            near[k:k + 64] = (octets[k:k + 64, None, :] == octets[None, :, :]).sum(2) >= least * n
        return _forest(ids, near & cross)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return _units(members, ["band", "hash"], "size").mapInArrow(_each_unit(["band", "hash"], work, schema), "a long, b long")


def _jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """Exact similarities of all pairs of ascending distinct hashes; columns of the incidence matrix are taken in pieces."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = np.zeros((2, 2))
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        every = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(every, kind="stable")
        every, row = every[order], row[order]
        new = np.concatenate(([True], every[1:] != every[:-1]))
        code = np.cumsum(new) - 1
        often = np.bincount(code) > 1  # others meet nothing
        code, row = (np.cumsum(often) - 1)[code[often[code]]], row[often[code]]
        both = np.zeros((len(sets), len(sets)))
        for lo in range(0, int(often.sum()), 8192):
            s, e = np.searchsorted(code, (lo, lo + 8192))
            part = np.zeros((len(sets), min(8192, int(often.sum()) - lo)), dtype=np.float32)
            part[row[s:e], code[s:e] - lo] = 1
            both += part @ part.T
    return both / np.maximum(size[:, None] + size[None, :] - both, 1)


def verify(groups: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Per class and unit (rep, root, links): a spanning forest of the true links and the number of documents linked to.

    ``groups``: (rep, doc_id, k1, k2, copies, root) of candidate groups; a class is read from a row of its least doc_id whose set has its
    digest, since that doc_id may name other texts too.
    """
    kept = ["rep", "copies", "root", "size"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows of one id meet in one task, so a class that is repeated there goes on once
        for batch in batches:
            for piece in slices(batch):
                h, bounds = shingles(piece.column("text"))
                k1, k2, rep = (piece.column(c).to_pylist() for c in ("k1", "k2", "rep"))
                grams, at = [], []
                for k in range(len(piece)):
                    own = np.unique(h[bounds[k]:bounds[k + 1]])
                    if rep[k] not in seen and [x.astype(np.int64) for x in digest(own)] == [k1[k], k2[k]]:
                        seen.add(rep[k])
                        grams.append(own.tobytes())
                        at.append(k)
                some = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(piece.column(c).take(some) for c in kept), pa.array(grams, pa.binary())], names=[*kept, "grams"])

    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    # A shuffle at every size: a broadcast of the members would grow with the documents.
    texts = docs.select("doc_id", "text").join(groups.join(sizes, "root").hint("merge"), "doc_id").select(*kept, "k1", "k2", "text")
    members = texts.mapInArrow(sets, "rep long, copies long, root long, size long, grams binary")

    def work(part: pa.Table) -> list[tuple]:
        ids, first = np.unique(np.asarray(part.column("rep")), return_index=True)  # a class may come from several tasks
        part = part.take(pa.array(first))
        if len(part) < 2:
            return []
        _, cross = _crossed(part)
        near = (_jaccard([np.frombuffer(x, dtype=np.uint64) for x in part.column("grams").to_pylist()]) >= threshold - 1e-9) & cross
        links = near @ np.asarray(part.column("copies")).astype(np.int64)
        root = dict(_forest(ids, near))
        return [(int(d), root.get(int(d), int(d)), int(n)) for d, n in zip(ids, links) if n]

    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
    return _units(members.withColumnRenamed("root", "grp"), ["grp"], "size").mapInArrow(_each_unit(["grp"], work, schema), "rep long, root long, links long")


def _linked(rows: DataFrame, docs: DataFrame, threshold: float, bands: int) -> DataFrame:
    """(k1, k2, rep, class_id, n_links) of all classes of copies in ``rows``; rep is the same for all classes that are linked."""
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    # Written down with its number, a class keeps it.
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    sets = rows.join(classes, ["k1", "k2", "doc_id"]).dropDuplicates(["rep"]).select("rep", "bands", "octets")
    groups = stored(components(candidates(sets, threshold, bands)).withColumnRenamed("vertex", "rep").join(classes, "rep"), "groups")
    found = stored(verify(groups, docs, threshold), "links")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("vertex", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    least = roots.join(classes.select("rep", "doc_id"), "rep").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return (classes.join(links, "rep", "left").join(roots.join(least, "root"), "rep", "left")
            .select("k1", "k2", F.coalesce("root", "rep").alias("rep"), F.coalesce("class_id", "doc_id").alias("class_id"),
                    (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))


def link(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per document its doc_id, class_id (least doc_id of its class) and n_links: documents at least ``threshold`` similar to it, copies too."""
    bands = plan_bands(threshold, recall)
    rows = stored(signatures(docs.select("doc_id", "text"), bands), "signatures")
    done = _linked(rows, docs, threshold, bands).drop("rep")
    return rows.select("doc_id", "k1", "k2").join(done, ["k1", "k2"], "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class: one of its least doc_id.  Rows without doc_id stay, as do those without words.

    Rows are numbered and written down, so that a row goes or stays by its own text whatever other rows share its doc_id.
    """
    bands, (row,) = plan_bands(threshold, recall), fresh(docs, "_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = stored(signatures(numbered.select("doc_id", F.col(row).alias("row"), "text"), bands).where("k1 is not null"), "signatures")
    linked = rows.join(_linked(rows, numbered, threshold, bands), ["k1", "k2"]).where("doc_id = class_id")
    first = F.row_number().over(Window.partitionBy("rep").orderBy("row"))
    stay = linked.select("row", "rep").withColumn("_n", first).where("_n = 1").select("row")
    gone = stored(rows.select("row").join(stay, "row", "left_anti").withColumnRenamed("row", row), "gone")
    return numbered.join(gone.hint("merge"), row, "left_anti").select(*docs.columns)
