"""A cleaning pipeline for training text: toxic, copied and contaminated documents go, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets as its documents, after a write and a read; the last returns
pieces of packed sequences.

Null, empty and wordless texts pass all stages unchanged, as texts without conspicuous words that are like no other; of repeated rows one
stays; different texts under one doc_id are judged each for itself; extra columns pass through to the last stage; an empty table gives no
pieces.
"""

from __future__ import annotations

from tickloom.llm import decontaminate, jaccard_join, packing, secrets, toxicity
from tickloom.llm.text import stored, table


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark, docs, sf_dir):
    """Of each class of near-duplicates (five-word shingles, Jaccard similarity 0.8 or more) the least doc_id stays."""
    return jaccard_join.deduplicate(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that repeat benchmark passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark, docs, sf_dir):
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def pack(spark, docs, sf_dir):
    """The rest becomes sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", keep_one_of_each), ("decontamination", drop_contaminated), ("secrets", mask_secrets),
          ("packing", pack)]

#: The toxicity model and the tokenizer are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in order over the documents of ``sf_dir``, each written as Parquet and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
