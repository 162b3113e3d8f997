"""URL verdicts by host rules, else by the ratio of two character language models.

A rule ``host/path`` fits its host and all subdomains where the URL's path starts with the rule's path; the longest fitting rule decides.
URLs that no rule decides are judged by variable-order Markov models of accepted and of rejected URLs (those that a rule decides), which
read the whole URL, scheme, query and fragment included, with its host in lower case:
Witten-Bell smoothing blends the orders 0 to ``ORDER``, and the score is the log-likelihood difference per character.  The threshold is
calibrated on the fifth of the rule-decided URLs that the models do not see (crc32 of the id as text, modulo 5, is 0): least mean of both
error rates, the middle of the widest such range.

All URLs with a rule are counted exactly.  A gram, its context's length, context and character in one number, stands for itself without
hashing, so the counts grow with the URLs; they are tables, merged inside each task and then by key, and joined to the distinct grams
of the URLs to be scored.  Nothing of them is broadcast or sent to the driver.

The host ends at the first ``/``, ``?``, ``#`` after the first ``://``; the path ends at ``?`` or ``#``.  A null URL or one without
``://`` has an empty host and path and fits no rule; the latter is scored by its text, a null or empty one scores 0.  Where one of the
classes has no URL, as in an empty table, every score and the threshold are 0;
a score at the threshold is accepted.  Repeated rows are judged row by row; very long URLs whole; extra columns pass through ``parts``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.llm.text import bounded, fold, fresh, slices, stored, utf8

# The rules and their verdicts.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
ORDER = 5  # a gram fits in 64 bits: three for the length of its context, eight for each character
BLOCKS, BLOCK_BYTES = 1024, 1 << 19  # of scored URLs: least number, and text in each
STEPS = 2000  # of the calibration histogram, over scores from -RANGE to RANGE
RANGE = 10.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return pages.withColumns({"host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER),
                              "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def whole() -> Column:
    """The text that the models read: ``url`` with its ``host`` as it stands after :func:`parts`."""
    start = F.instr("url", "://")
    tail = F.substring(F.col("url"), start + 3 + F.length("host"), F.length("url"))
    return F.coalesce(F.when(start > 0, F.concat(F.substring(F.col("url"), F.lit(1), start + 2), "host", tail)).otherwise(F.col("url")), F.lit(""))


def rule(rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits ``host`` and ``path``, or NULL."""
    out = F.lit(None).cast("string")
    for text in sorted(rules, key=len):  # the longest is asked first
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per position its gram of the highest order, and its row; the lengths of the rows."""
    raw, bounds = utf8(column)
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    before = np.minimum(np.arange(len(raw)) - np.repeat(bounds[:-1], size), ORDER)
    wide, context = raw.astype(np.int64), np.zeros(len(raw), np.int64)
    for back in range(1, min(ORDER + 1, len(raw))):
        context[back:] |= np.where(before[back:] >= back, wide[:-back] << (8 * back - 8), 0)
    return ((before << (8 * ORDER) | context) << 8) | wide, row, size


def lower(gram: Column, order: int) -> Column:
    """The gram of a position at ``order``, from that of a higher one; a context cut off by the start of its URL stays as it is."""
    cut = gram.bitwiseAND(F.lit((1 << (8 * order + 8)) - 1)) + F.lit(order << (8 * ORDER + 8))
    return F.when(F.shiftright(gram, 8 * ORDER + 8) > order, cut).otherwise(gram)


def _orders(grams: DataFrame, *others: str) -> DataFrame:
    """Each gram of the highest order as one row (o, gram) per order."""
    levels = F.explode(F.array(*(F.struct(F.lit(o).alias("o"), lower(F.col("gram"), o).alias("gram")) for o in range(ORDER + 1))))
    return grams.select(*others, levels.alias("c")).select(*others, "c.*")


@dataclass
class _Look:
    """Counts by (order, class), for tests and small models."""

    counts: DataFrame
    name: str

    def __getitem__(self, at: tuple[int, int]) -> np.ndarray:
        return np.array([r[0] for r in self.counts.where(F.col("o") == at[0]).select(f"{self.name}{at[1]}").collect()])


@dataclass
class Model:
    """Exact counts of both classes as tables: ``grams`` (o, gram, c0, c1), and by context (o, context) the characters counted, n0 and n1,
    and the distinct ones, t0 and t1."""

    grams: DataFrame
    contexts: DataFrame
    empty: bool = False

    @property
    def seen(self) -> _Look:
        return _Look(self.contexts, "n")

    @property
    def distinct(self) -> _Look:
        return _Look(self.contexts, "t")

    @property
    def gram(self) -> _Look:
        return _Look(self.grams, "c")

    def scores(self, column: pa.Array) -> np.ndarray:
        """Scores of a few texts."""
        few = self.grams.sparkSession.createDataFrame(list(enumerate(column.to_pylist())), "k long, text string")
        return np.array([r["score"] for r in sorted(score(few, self).collect(), key=lambda r: r["k"])])


def train(urls: DataFrame) -> Model:
    """Models from (text, accepted): grams of the highest order merged per slice and by key, those of lower orders counted from them."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                gram, row, _ = _grams(piece.column("text"))
                side = np.asarray(piece.column("accepted").cast(pa.int8()))[row].astype(np.int64)
                key, n = np.unique(gram * 2 + side, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(n * (1 - key % 2)), pa.array(n * (key % 2))], names=["gram", "c0", "c1"])

    merged = lambda rows, *by: rows.groupBy(*by).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    top = merged(bounded(urls).mapInArrow(task, "gram long, c0 long, c1 long"), "gram")
    grams = stored(merged(_orders(top, "c0", "c1"), "o", "gram"), "grams")
    contexts = grams.groupBy("o", F.shiftright("gram", 8).alias("context")).agg(
        F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), F.count_if(F.col("c0") > 0).alias("t0"), F.count_if(F.col("c1") > 0).alias("t1"))
    both = grams.where("o = 0").agg(F.max("c0"), F.max("c1")).first()
    return Model(grams, contexts, empty=not (both[0] and both[1]))


def _ratios(grams: DataFrame, model: Model) -> DataFrame:
    """Per distinct gram of the highest order the log ratio of its likelihoods, order by order: each gram asks the one below it, which at
    most 257 of them do."""
    known = (_orders(grams).distinct().withColumn("context", F.shiftright("gram", 8))
             .join(model.grams, ["o", "gram"], "left").join(model.contexts, ["o", "context"], "left").drop("context"))
    known = stored(known.na.fill(0), "known")
    below = None
    for order in range(ORDER + 1):
        own = known.where(F.col("o") == order).drop("o")
        if order:
            own = own.withColumn("below", lower(F.col("gram"), order - 1)).join(below, "below")
        else:
            own = own.select("*", F.lit(1 / 256).alias("p0"), F.lit(1 / 256).alias("p1"))
        p = [F.when(F.col(f"n{k}") > 0, (F.col(f"c{k}") + F.col(f"t{k}") * F.col(f"p{k}")) / (F.col(f"n{k}") + F.col(f"t{k}"))).otherwise(F.col(f"p{k}"))
             for k in (0, 1)]
        below = own.select(F.col("gram").alias("below"), p[0].alias("p0"), p[1].alias("p1"))
    return below.select(F.col("below").alias("gram"), (F.log("p1") - F.log("p0")).alias("ratio"))


def score(urls: DataFrame, model: Model) -> DataFrame:
    """``urls`` with the log-likelihood difference per character of ``text`` (positive: like the accepted ones) instead of ``text``.

    Rows are dealt into blocks of about ``BLOCK_BYTES`` of text; of each block the distinct grams are looked up, by joins on the gram, and
    come back to it.  Equal rows move as one with their number, so a row that repeats often fills no block.
    """
    names = [c for c in urls.columns if c != "text"]
    if model.empty:
        return urls.select(*names, F.lit(0.0).alias("score"))
    count, block = fresh(urls, "_count", "_block")
    size = urls.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(BLOCKS, size // BLOCK_BYTES)
    rows = bounded(urls).groupBy(*urls.columns).agg(F.count(F.lit(1)).alias(count))
    rows = rows.withColumn(block, F.pmod(F.xxhash64(*urls.columns), F.lit(blocks)))

    def ask(texts: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)]
        for batch in texts.combine_chunks().to_batches():
            found += [np.unique(_grams(piece.column("text"))[0]) for piece in slices(batch)]
        gram = np.unique(np.concatenate(found))
        own = texts.column(block)[0].as_py() if texts.num_rows else 0
        return pa.table({block: np.full(len(gram), own, np.int64), "gram": gram})

    def answer(texts: pa.Table, known: pa.Table) -> pa.Table:
        gram, ratio = np.asarray(known.column("gram")), np.asarray(known.column("ratio"))
        order = np.argsort(gram)
        gram, ratio, out = gram[order], ratio[order], []
        for batch in texts.combine_chunks().to_batches():
            for piece in slices(batch):
                own, row, length = _grams(piece.column("text"))
                sums = np.bincount(row, weights=ratio[np.searchsorted(gram, own)], minlength=len(length)) if len(own) else np.zeros(len(length))
                out.append(pa.RecordBatch.from_arrays([*(piece.column(c) for c in [*names, count]), pa.array(sums / np.maximum(length, 1))],
                                                      names=[*names, count, "score"]))
        return pa.Table.from_batches(out) if out else texts.select([*names, count]).append_column("score", pa.array([], pa.float64()))

    asked = stored(rows.groupBy(block).applyInArrow(ask, f"{block} long, gram long"), "asked")
    told = asked.join(_ratios(asked.select("gram").distinct(), model), "gram").select(block, "gram", "ratio")
    schema = T.StructType([f for f in urls.schema.fields if f.name != "text"] + [T.StructField(count, T.LongType()), T.StructField("score", T.DoubleType())])
    scored = rows.groupBy(block).cogroup(told.groupBy(block)).applyInArrow(answer, schema)
    return scored.withColumn(count, F.explode(F.sequence(F.lit(1), F.col(count)))).drop(count)


def calibrate(scored: DataFrame) -> float:
    """The threshold with the least mean error of both classes of (accepted, score); 0 where one class is missing."""
    step = F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), F.floor((F.col("score") + RANGE) / (2 * RANGE / STEPS)))).cast("int")
    hist = np.zeros((2, STEPS))
    for r in scored.groupBy(F.col("accepted").cast("int").alias("k"), step.alias("s")).count().collect():  # at most 2 x STEPS rows
        hist[r["k"], r["s"]] = r["count"]
    if not hist.sum(1).all():
        return 0.0
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(hist, axis=1)), axis=1) / hist.sum(1, keepdims=True)
    error = below[1] + 1 - below[0]  # accepted ones under the threshold, rejected ones from it on
    best = np.flatnonzero(error <= error.min() + 1e-12)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=len)
    return float((widest[0] + widest[-1]) / 2 * (2 * RANGE / STEPS) - RANGE)


def judge(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Per page its page_id, host, path, the rule that decides (else NULL) and the verdict."""
    ruled = parts(pages.select("page_id", "url")).withColumns({"rule": rule(rules), "text": whole()}).drop("url")
    accepted = F.col("rule").isin([r for r, v in rules.items() if v == "allow"])
    known = ruled.where(F.col("rule").isNotNull()).select("page_id", "text", accepted.alias("accepted"))
    model = train(known.where(fold(5, "page_id") != 0).select("text", "accepted"))
    scored = stored(score(ruled, model), "scores")
    known = scored.where(F.col("rule").isNotNull() & (fold(5, "page_id") == 0))
    threshold = calibrate(known.select(accepted.alias("accepted"), "score"))
    by_rule = F.when(accepted, "allow").otherwise("block")
    verdict = F.when(F.col("rule").isNotNull(), by_rule).when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
