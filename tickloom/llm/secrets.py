"""Secrets in whole texts: fixed patterns, and values in a credential context whose guess cost is high.

Patterns (``assign``, ``access``, ``hex``) are matched leftmost and non-overlapping per kind; matches that are too short are dropped
afterwards, so they still use up their text.  Any value that follows a credential word (``CONTEXT``) is priced by dynamic programming:

    cost(j) = min over segments [i, j) of cost(i) + price(segment) + SEGMENT

over words (of a common list, of the surrounding text, or of the at most ``DICTIONARY`` most frequent words of all documents), dates, repeats of
up to ``UNIT`` characters, keyboard walks and sequences, and single characters guessed by brute force; prices are decimal logarithms of
the guesses.  Every part of a walk or repeat is a segment too, so the cost is the least of all segmentations.  A value that needs at least
10^``GUESSES`` guesses is a span of kind ``guess``, unless a span of the fixed patterns covers it.

A null or empty text has no spans; an empty table gives no rows and an empty dictionary; words of equal count are ranked by their letters;
repeated rows are searched (and counted) row by row; offsets are code points with an exclusive end; texts and values of any length are
searched whole; extra columns pass through ``find`` and ``redact``, a column ``spans`` under a new name.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.llm.text import bounded, fresh, stored

KINDS = ("assign", "access", "hex", "guess")
# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # a run is maximal either way

CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|auth(?:orization)?|login|pin)["']?"""
                     r"""(?:\x20{0,2}(?::=|[:=])|\x20(?:is|was))\x20{0,2}["'`]?([^\s"'`]{6,})""", re.ASCII | re.IGNORECASE)
GUESSES = 10.0
SEGMENT = 0.3
UNIT = 12  # characters that a repeat repeats
DICTIONARY = 20_000  # words of the corpus that are kept, the most frequent ones; bounds what is broadcast
_HELD = 200_000  # distinct words that a task counts before it passes them on
_WHOLE = 1 << 20  # characters of a text whose words are listed at once

# Frequent words of passwords, most frequent first.
COMMON = ("password", "qwerty", "admin", "welcome", "letmein", "monkey", "dragon", "master", "login", "princess", "sunshine", "shadow",
          "football", "baseball", "superman", "batman", "trustno", "hello", "freedom", "whatever", "secret", "root", "user", "guest",
          "test", "default", "changeme", "example", "token", "apikey", "access", "love", "summer", "winter", "spring", "autumn", "pass",
          "company", "server", "database", "system", "manager", "computer", "internet", "michael", "jordan", "daniel", "jessica", "iloveyou")
# The rows of a keyboard.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, k) for r, row in enumerate(KEYBOARD) for k, c in enumerate(row)}
_RANK = {w: k + 1 for k, w in enumerate(COMMON)}
_LEET = str.maketrans("4@310$5!7", "aaeiossit")
_WORD = re.compile(r"[^\W\d_]{3,32}")
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d", re.ASCII)
_BRUTE = {"lower": math.log10(26), "upper": math.log10(26), "digit": 1.0, "sign": math.log10(33), "other": 2.0}


def _class(c: str) -> str:
    return ("other" if c > "\x7f" else "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "sign")


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


# Walks: whether the second character follows the first, and the price of a walk of one character.
_WALKS = ((_near, math.log10(47 * 4)), (lambda a, b: ord(b) - ord(a) == 1, 1.5), (lambda a, b: ord(a) - ord(b) == 1, 1.8))


class _Starts:
    """Starts of segments of one run, whose price grows with the logarithm of their length.

    A start with a later one that is no dearer never gives the least cost again, and neither does a start that an earlier one has caught
    up with, since the lead of the nearer start only shrinks.  Both are forgotten, which keeps the list short and the minimum exact.
    """

    def __init__(self):
        self.kept: list[tuple[int, float]] = []

    def add(self, start: int, cost: float) -> None:
        while self.kept and self.kept[-1][1] >= cost:
            self.kept.pop()
        self.kept.append((start, cost))

    def least(self, end: int) -> float:
        """Of the costs up to a start plus the logarithm of the length from there."""
        best, stay = math.inf, []
        for start, cost in self.kept:
            value = cost + math.log10(end - start)
            if value < best:
                best = value
                stay.append((start, cost))
        self.kept = stay
        return best


def _words(value: str, low: str, known: tuple[dict[str, int], ...]) -> Iterator[tuple[int, int, float]]:
    """Segments that are words, also with digits and signs for letters, and dates."""
    plain = low.translate(_LEET)
    for i in range(len(low)):
        for j in range(i + 3, min(i + 32, len(low)) + 1):
            ranks = [(r[w], extra) for w, extra in ((low[i:j], 0.0), (plain[i:j], 0.5)) for r in known if w in r]
            if ranks:
                yield i, j, min(math.log10(rank + 1) + extra for rank, extra in ranks) + (0.3 if value[i:j] != low[i:j] else 0)
        if "0" <= value[i] <= "9":
            for j in range(i + 4, min(i + 10, len(value)) + 1):
                if _DATE.fullmatch(value, i, j):
                    yield i, j, math.log10(365 * 120) if j - i > 4 else math.log10(120)


def guess_cost(value: str, *known: dict[str, int]) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` needs; ``known``: ranks of words beside ``COMMON``."""
    low = value.lower()
    if len(low) != len(value):
        low = value
    brute = [0.0, *itertools.accumulate(_BRUTE[_class(c)] for c in low)]
    price: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _words(value, low, (_RANK, *known)):
        price.setdefault(j, []).append((i, cost))
    best = [0.0] * (len(value) + 1)
    walks, first = [_Starts() for _ in _WALKS], [0] * len(_WALKS)  # a run's starts, and where the run begins
    repeats, since = [[_Starts() for _ in range(u)] for u in range(UNIT + 1)], [0] * (UNIT + 1)
    for j in range(1, len(value) + 1):
        least = best[j - 1] + _BRUTE[_class(value[j - 1])]
        for i, cost in price.get(j, ()):
            least = min(least, best[i] + cost + SEGMENT)
        for k, (follows, base) in enumerate(_WALKS):
            if j > 1 and not follows(low[j - 2], low[j - 1]):
                walks[k], first[k] = _Starts(), j - 1
            if j - 3 >= first[k]:  # a walk has three characters or more
                walks[k].add(j - 3, best[j - 3])
                least = min(least, walks[k].least(j) + base + SEGMENT)
        for u in range(1, min(UNIT, j - 1) + 1):
            if low[j - 1] != low[j - 1 - u]:
                if since[u] + 2 * u < j:  # something was kept
                    repeats[u] = [_Starts() for _ in range(u)]
                since[u] = j - u
            size = max(2 * u, 3)
            if j - size >= since[u]:
                starts = repeats[u][j % u]
                starts.add(j - size, best[j - size])
                least = min(least, starts.least(j) - math.log10(u) + brute[j] - brute[j - u] + SEGMENT)
        best[j] = least
    return best[-1]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= LEAST["access"]]
    return out + [(m.start(), "hex", m.end()) for m in _LONG_HEX.finditer(text)]


def added_spans(text: str, base: list[tuple[int, str, int]], guesses: float = GUESSES, words: dict[str, int] | None = None) -> list[tuple[int, str, int]]:
    """Values in a credential context that no base span covers and whose guess cost is high; ``words``: ranks of the corpus' words."""
    found, known = [m.span(1) for m in CONTEXT.finditer(text)], None
    begins = sorted((s, e) for s, _, e in base)
    ends = [-1, *itertools.accumulate((e for _, e in begins), max)]  # the furthest end of the spans that begin so far
    out = []
    for start, end in found:
        value = text[start:end].rstrip(".,;:!?)]}>")
        end = start + len(value)
        if len(value) < 6 or ends[bisect.bisect_right(begins, (start, math.inf))] >= end:
            continue
        if known is None:  # words of the text outside all such values, frequent first
            count: dict[str, int] = {}
            rest = "".join(text[a:b] for a, b in zip([0] + [e for _, e in found], [s for s, _ in found] + [len(text)]))
            for w in _WORD.findall(rest.lower()):
                count[w] = count.get(w, 0) + 1
            known = {w: k + 1 for k, w in enumerate(sorted(count, key=lambda w: (-count[w], w)))}
        if guess_cost(value, known, words or {}) >= guesses:
            out.append((start, "guess", end))
    return out


def _sorted(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def all_spans(text: str | None, guesses: float = GUESSES, words: dict[str, int] | None = None) -> list[tuple[int, str, int]]:
    base = base_spans(text or "")
    return _sorted(base + added_spans(text or "", base, guesses, words))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> dict[str, int]:
    """The most frequent words of all texts with their ranks: counted inside the tasks, then added up by word.  At most ``size`` words are
    kept; of words of like count all or none are, so nothing depends on an order among them, and only kept words reach the driver."""
    def flush(count: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count.keys()), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            for x in b.column("text"):
                text = x.as_py() or ""
                count.update(_WORD.findall(text.lower()) if len(text) <= _WHOLE else (m.group().lower() for m in _WORD.finditer(text)))
                if len(count) >= _HELD:
                    yield flush(count)
                    count = Counter()
        yield flush(count)

    words = stored(bounded(docs.select("text")).mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # Words by count, rounded down to ten leading bits: some ten thousand rows at most, whatever the corpus.
    level = F.expr("n - n % shiftleft(1L, greatest(length(bin(n)) - 10, 0))")
    least, kept = math.inf, 0
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        kept += r["count"]
        if kept > size:
            break
        least = r["level"]
    if least == math.inf:
        return {}
    rows = sorted(words.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))  # at most ``size``
    return {r["word"]: k + 1 for k, r in enumerate(rows)}


def find(docs: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """``docs`` with ``spans``: every span as (start, kind, end), in order of start and kind; the kind ``guess`` is the added one.
    An own column ``spans`` becomes ``spans_in``, with underscores before it where that is taken."""
    words = docs.sparkSession.sparkContext.broadcast(dictionary(docs))
    docs = docs.withColumnRenamed("spans", fresh(docs, "spans_in")[0])
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": s, "kind": k, "end": e} for s, k, e in all_spans(x.as_py(), guesses, words.value)] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*batch.schema.names, "spans"])

    return bounded(docs).mapInArrow(task, T.StructType(docs.schema.fields + [T.StructField("spans", kind)]))


def report(docs: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """Per document the counts of the base kinds, a digest of the base spans, and all spans as text."""
    words = docs.sparkSession.sparkContext.broadcast(dictionary(docs))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [all_spans(x.as_py(), guesses, words.value) for x in b.column("text")]
            text = [[f"{k}:{s}:{e}" for s, k, e in r] for r in rows]
            base = [",".join(t for t in x if not t.startswith("guess:")) for x in text]
            counts = [pa.array([sum(k == kind for _, k, _ in r) for r in rows], pa.int64()) for kind in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                 pa.array([",".join(x) for x in text], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return bounded(docs.select("doc_id", "text")).mapInArrow(task, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, guesses: float = GUESSES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every maximal run of span text replaced by ``mark``; null texts stay null, ``n_chars`` follows the text."""
    names, words = docs.columns, docs.sparkSession.sparkContext.broadcast(dictionary(docs))

    def hide(text: str | None) -> str | None:
        spans, out, done = sorted((s, e) for s, _, e in all_spans(text, guesses, words.value)), [], 0
        for s, e in spans:
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return text if not out else "".join(out) + text[done:]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([hide(x.as_py()) for x in b.column(at)], b.schema.field(at).type))

    out = bounded(docs).mapInArrow(task, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
