"""Document fingerprints from closed syncmers, as Spark expressions only.

A text is read as pieces: runs without white space, cut after every eight characters.  A k-mer of ``K`` consecutive pieces is a closed
syncmer if the least of its inner substrings of ``S`` pieces (by hash) is the first or the last one.  Whether a k-mer is chosen depends on
nothing but itself, so equal passages yield the same anchors wherever they stand (``anchors`` gives their positions).  The fingerprint is
the ``SKETCH`` least hashes of the chosen k-mers, of 40 bits each, in hexadecimal; the likeness of two fingerprints is the share of the
``SKETCH`` least hashes of both that are in either one.

A text with pieces but without a chosen k-mer (fewer than ``K`` pieces) has the hash of its pieces as its only anchor; a null or blank
text has an empty fingerprint; two empty ones are alike (1), an empty and a full one are not (0).  Rows that repeat a doc_id are
fingerprinted each for itself; as the next document the one with the least hash of its text stands for all of them.  A row without doc_id
has no next document: its edited text is its kept half and its likeness to the next document 0.  Extra columns are ignored.

The next document in the order of doc_id is found on ids alone, inside buckets of ids, then over the buckets, then over groups of those;
texts move once by their own id, and the needed part of them once by the id of their predecessor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.llm.text import stored

K, S, SKETCH = 5, 2, 64
BUCKET = 1024  # ids per bucket, buckets per group
_WINDOW = K - S + 1


def _inner(text: Column) -> Column:
    """Hashes of all substrings of ``S`` = 2 pieces, in order."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(r"\S{1,8}"), F.lit(0)), lambda p: F.xxhash64(p))
    return F.transform(F.array(pieces), lambda h: F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.xxhash64(a, b)))[0]


def _chosen(inner: Column, value) -> Column:
    """``value(i, hash)`` for each closed syncmer; the last inner substring of a text is a half pair and left out."""
    def at(i: Column) -> Column:
        part = [F.get(inner, i + j) for j in range(_WINDOW)]
        least = F.least(*part)
        return F.when((part[0] == least) | (part[-1] == least), value(i, F.shiftrightunsigned(F.xxhash64(*part), 24)))

    n = F.size(inner) - _WINDOW
    return F.when(n >= 1, F.array_compact(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)))


def anchors(text: Column) -> Column:
    """The closed syncmers of a text: number of the first piece, and hash."""
    return F.transform(F.array(_inner(text)), lambda g: F.coalesce(
        _chosen(g, lambda i, h: F.struct(i.alias("piece"), h.alias("hash"))), F.expr("cast(array() as array<struct<piece: int, hash: bigint>>)")))[0]


def sketch(text: Column) -> Column:
    """The least hashes of a text's anchors, ascending."""
    def least(g: Column) -> Column:
        chosen = F.sort_array(F.array_distinct(_chosen(g, lambda i, h: h)))
        hashes = F.when(F.size(chosen) > 0, chosen)  # one or two k-mers may all be no closed syncmers
        short = F.when(F.size(g) > 0, F.array(F.shiftrightunsigned(F.xxhash64(g), 24)))
        none = F.expr("cast(array() as array<bigint>)")
        return F.slice(F.coalesce(hashes, short, none), F.lit(1), F.lit(SKETCH))

    return F.transform(F.array(_inner(F.coalesce(text, F.lit("")))), least)[0]


def fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among the least of both sketches."""
    both = F.slice(F.sort_array(F.array_union(a, b)), F.lit(1), F.lit(SKETCH))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both)).cast("double")


def with_previous(ids: DataFrame) -> DataFrame:
    """Rows (doc_id, n, h), one per id, with the id and n of the id before (before the first: of the last)."""
    low = ids.withColumn("b", F.floor(F.col("doc_id") / BUCKET))
    own = lambda key, by: W.partitionBy(key).orderBy(by)
    low = low.withColumns({"p_id": F.lag("doc_id").over(own("b", "doc_id")), "p_n": F.lag("n").over(own("b", "doc_id"))})
    last = lambda by: [F.max(by).alias("l_id"), F.max_by("n" if by == "doc_id" else "l_n", by).alias("l_n")]
    mid = low.groupBy("b").agg(*last("doc_id")).withColumn("g", F.floor(F.col("b") / BUCKET))
    mid = mid.withColumns({"m_id": F.lag("l_id").over(own("g", "b")), "m_n": F.lag("l_n").over(own("g", "b"))})
    top = mid.groupBy("g").agg(F.max("l_id").alias("l_id"), F.max_by("l_n", "l_id").alias("l_n"))
    every = W.orderBy("g")  # one row per BUCKET x BUCKET ids
    whole = W.partitionBy(F.lit(1))
    top = top.select("g", F.coalesce(F.lag("l_id").over(every), F.max("l_id").over(whole)).alias("t_id"),
                     F.coalesce(F.lag("l_n").over(every), F.max_by("l_n", "l_id").over(whole)).alias("t_n"))
    mid = mid.join(top, "g").select("b", F.coalesce("m_id", "t_id").alias("m_id"), F.coalesce("m_n", "t_n").alias("m_n"))
    return low.join(mid, "b").select("doc_id", "h", F.coalesce("p_id", "m_id").alias("previous"), F.coalesce("p_n", "m_n").alias("previous_n"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text (second half replaced from the next document) and both likenesses."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named, nameless = plain.where(F.col("doc_id").isNotNull()), plain.where(F.col("doc_id").isNull())
    ids = stored(named.groupBy("doc_id").agg(F.max(F.char_length("text")).cast("long").alias("n"), F.min(F.xxhash64("text")).alias("h")), "ids")
    # Both joins take ``named`` as it is by doc_id, so its texts are moved once and read twice.
    known = named.join(with_previous(ids), "doc_id").where(F.col("h").bitwiseXOR(F.xxhash64("text")) == 0)
    half = (F.col("previous_n") / 2).cast("int")
    following = known.select(F.col("previous").alias("doc_id"), F.substring("text", F.lit(1), half).alias("part"),
                             sketch(F.col("text")).alias("next")).dropDuplicates(["doc_id"])  # equal texts under one id give equal rows
    n = F.char_length("text")
    cut = (n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("part", F.lit("")), F.lit(1), cut))
    alone = nameless.select("doc_id", "text", F.lit(None).cast("string").alias("part"), F.lit(None).cast("array<bigint>").alias("next"))
    both = (named.join(following, "doc_id", "left").unionByName(alone)
            .select("doc_id", n.cast("long").alias("n_chars"), F.col("text").alias("own"), edited.alias("edited"), "next")
            .select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    sketch(F.col("own")).alias("a"), sketch(F.col("edited")).alias("b"), "next"))
    return both.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"),
                       likeness(F.col("a"), F.col("b")).alias("near_edited"),
                       F.coalesce(likeness(F.col("a"), F.col("next")), F.lit(0.0)).alias("near_next"))
