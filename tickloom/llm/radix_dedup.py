"""Exact deduplication by distributed most-significant-digit radix partitioning of the texts' bytes.

Two texts are equal when their normalised bytes are (runs of blanks are one space).  No digest decides: a group of texts is split by the
next digit, a span of successive bytes, until it has one member or its texts have ended; what ends together is equal.

1. Every task splits its own texts this way, slice by slice.  Texts met several times in a task stay in a bounded memo, so a text that a
   third of all rows repeat leaves a task once, as the *head* of its local group.  Rows, heads and the heads' texts are written down.
2. The heads of all tasks are split by the first digit: the length, which stands before the text, and the first ``FIRST`` bytes.  Counts
   are merged map-side, and groups of one are done.
3. What is left is shuffled on (group, next digit) level by level, ``DIGIT`` bytes first and ``LONG`` bytes after that.  Only equal
   digits of one group meet; a text is at most once per task in it, so no task's share grows with the number of copies.
4. Group sizes and least ids are added up per head, then per class, and joined back to the rows on their head.

Defined cases: a null text is an empty one; empty texts are equal to each other (and a text of blanks only is one space, not empty).
Of equal texts the row with the least id stays, a null id after all others, and of rows that also share the id one stays; each row counts
for the group's size, repeated ones too.  An empty table gives no rows.  Further columns are ignored by ``classes`` and kept, with their
names, by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict, defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tickloom.llm.text import bounded, slices, stored

#: Bytes of the first digit, of the second, and of all further ones.
FIRST, DIGIT, LONG = 32, 64 << 10, 1 << 20
#: Bytes of texts that a task remembers because it met them more than once.
MEMO_BYTES = 16 << 20
BLANKS = "[\\x20\\x09-\\x0D]+"


def radix_groups(texts: Sequence[bytes], first: int = FIRST) -> list[list[int]]:
    """Positions of equal texts: groups are split by successive bytes until they have one member or have ended."""
    ended, waiting = [], [(list(range(len(texts))), 0, first)]
    while waiting:
        members, at, width = waiting.pop()
        parts = defaultdict(list)
        for m in members:
            parts[texts[m][at:at + width]].append(m)
        for digit, part in parts.items():
            if len(part) == 1 or len(digit) < width:
                ended.append(part)
            else:
                waiting.append((part, at + width, 4 * width))
    return ended


def _local(keep: list[str], text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kept columns of a task's rows with the head of their local group; a head carries the normalised text and its SHA-256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, memo, held = TaskContext.get().partitionId() << 33, OrderedDict(), 0
        for batch in batches:
            for part in slices(batch, text):
                column = pc.fill_null(part.column(text), "").cast(pa.large_string())
                texts = [t.encode() for t in pc.replace_substring_regex(column, BLANKS, " ").to_pylist()]
                known, n = list(memo.items()), part.num_rows
                heads, bodies, shas = [0] * n, [None] * n, [None] * n
                for group in radix_groups([t for t, _ in known] + texts):
                    group.sort()
                    old = known[group[0]] if group[0] < len(known) else None
                    mine = group[1:] if old else group
                    if not mine:
                        continue
                    first = mine[0] - len(known)
                    head = old[1] if old else row + first
                    if old:
                        memo.move_to_end(old[0])
                    else:
                        bodies[first], shas[first] = texts[first], hashlib.sha256(texts[first]).hexdigest()
                        if len(mine) > 1:
                            memo[texts[first]] = head
                            held += len(texts[first])
                    for m in mine:
                        heads[m - len(known)] = head
                while held > MEMO_BYTES:
                    held -= len(memo.popitem(last=False)[0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(name) for name in keep]
                    + [pa.array(range(row, row + n), pa.int64()), pa.array(heads, pa.int64()),
                       pa.array([None if b is None else len(b) for b in bodies], pa.int64()),
                       pa.array([None if b is None else b[:FIRST] for b in bodies], pa.binary()),
                       pa.array([None if b is None else b[FIRST:] for b in bodies], pa.binary()), pa.array(shas, pa.string())],
                    names=[*keep, "row", "head", "length", "first", "rest", "sha"])
                row += n
    return run


def _split(heads: DataFrame, digit: int, long: int) -> DataFrame:
    """(head, class) of all heads whose text equals another head's, and of some that do not: the distributed levels."""
    groups = (heads.groupBy("length", "first").agg(F.min("head").alias("class"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # One way at every size: a broadcast of the groups would hold only while they are few.
    level = heads.select("head", "length", "first", "rest").join(groups.hint("merge"), ["length", "first"]).select("head", "class", "rest")
    done, width = None, digit
    while True:
        same = W.partitionBy("class", "digit")
        level = stored(
            level.select("head", "class", F.substring("rest", 1, width).alias("digit"), F.substring("rest", width + 1, 1 << 30).alias("more"))
            .select("head", F.min("head").over(same).alias("class"), F.when(F.count(F.lit(1)).over(same) > 1, F.col("more")).alias("more"))
            .select("head", "class", F.when(F.length("more") > 0, F.col("more")).alias("rest")), "radix")
        ended = level.where("rest IS NULL").select("head", "class")
        done = ended if done is None else done.unionByName(ended)
        level = level.where("rest IS NOT NULL")
        if level.isEmpty():
            return done
        width = long


def _named(docs: DataFrame, columns: list[str], text: str, key: str, digit: int, long: int) -> DataFrame:
    """The ``columns`` of all rows as c0, c1, ..., and keep_id, group_size, kept, sha of their class."""
    # Positional names: a document's own column may be called row or head.
    c = {name: f"c{k}" for k, name in enumerate(dict.fromkeys([*columns, text]))}
    source = docs.select(*[F.col(f"`{name}`").alias(short) for name, short in c.items()])
    keep = [f"c{k}" for k in range(len(columns))]
    schema = T.StructType(source.select(*keep).schema.fields + [T.StructField(n, t) for n, t in (
        ("row", T.LongType()), ("head", T.LongType()), ("length", T.LongType()), ("first", T.BinaryType()), ("rest", T.BinaryType()),
        ("sha", T.StringType()))])
    rows = stored(bounded(source).mapInArrow(_local(keep, c[text]), schema), "rows")
    heads = rows.where("row = head")
    # min_by over two longs stays a hash aggregate; it looks at rows that have an id.
    one = rows.groupBy("head").agg(F.min(c[key]).alias("id"), F.coalesce(F.min_by("row", c[key]), F.min("row")).alias("stays"),
                                   F.count(F.lit(1)).alias("n"))
    one = one.join(_split(heads, digit, long), "head", "left").withColumn("class", F.coalesce("class", "head"))
    total = one.groupBy("class").agg(F.min("id").alias("keep_id"), F.coalesce(F.min_by("stays", "id"), F.min("stays")).alias("stays"),
                                     F.sum("n").alias("group_size"))
    named = one.select("head", "class").join(total, "class").join(heads.select("head", "sha"), "head").drop("class")
    return (rows.select(*keep, "row", "head").join(named, "head")
            .select(*keep, "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), "sha"))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", digit: int = DIGIT, long: int = LONG) -> DataFrame:
    """One row per row of ``docs``: its ``key``, keep_id, group_size, kept, and text_sha256 of the normalised text."""
    return _named(docs, [key], text, key, digit, long).select(F.col("c0").alias(key), "keep_id", "group_size", "kept",
                                                              F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", digit: int = DIGIT, long: int = LONG) -> DataFrame:
    """The rows that stay, with all their columns and unchanged texts."""
    return _named(docs, docs.columns, text, key, digit, long).where("kept").select(
        *[F.col(f"c{k}").alias(name) for k, name in enumerate(docs.columns)])

