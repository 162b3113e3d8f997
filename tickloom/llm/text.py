"""Helpers on whole texts inside Arrow tasks: byte views, words, substring hashes, bounded slices of a batch."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A worker lives through many tasks.  With the C library's growing threshold, arrays of a few megabytes would come from its heap, leave
# holes there and never go back to the system; with a fixed one (parameter -3) each is given back as soon as it is freed.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL("libc.so.6").mallopt(-3, 2 << 20)

#: Bytes of text that a task holds in its working arrays at once (a single longer text is one slice).
SLICE_BYTES = 2 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POW: dict[str, np.ndarray] = {}

#: ASCII letters in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, lower-case letters, everything outside ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after the session was told to hand texts to Python in batches of few bytes, unless it has a limit of its own.

    The default counts rows only: ten thousand long documents would make one batch.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, "4m")
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local session, whose executors are one process, may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later passes, and tasks after a lost executor, scan a table."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``: the split between training and held-out rows."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``limit`` bytes of text each, or one row."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    total, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the n + 1 bounds of its rows; a null is an empty text."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["up"]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for name, base in (("up", _R), ("down", _RINV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
    return _POW["up"][:n], _POW["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits (the finaliser of a 64-bit murmur hash)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """n + 1 sums from which ``span_hash`` reads the hash of any span."""
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * powers(len(raw))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words of lower-cased ``raw``; a word never crosses a row's bound."""
    mask = WORD[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    before = np.concatenate(([False], mask))
    after = np.concatenate((mask, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a column in order, and the n + 1 bounds of its rows in words."""
    raw, bounds = utf8(column)
    raw = LOWER[raw]
    starts, ends = word_spans(raw, bounds)
    hashes = span_hash(prefix_hash(raw), starts, ends)
    return hashes, np.searchsorted(starts, bounds)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    padded = np.concatenate(([False], flags, [False]))
    change = np.flatnonzero(padded[1:] != padded[:-1])
    return change[::2], change[1::2]
