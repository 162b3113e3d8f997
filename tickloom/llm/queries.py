"""One query per operator: production parameters over the whole table."""

from tickloom.llm import (decontaminate, fingerprints, hard_negatives, jaccard_join, packing, pseudonyms, quality, radix_dedup, secrets,
                          suffix_dedup, toxicity, url_filter, whitening)
from tickloom.llm.registry import QUERIES, SQL, query  # noqa: F401
from tickloom.llm.text import table

OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(13, len(w)) AS k, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
hit AS (SELECT p.doc_id, p.s, ks.k, win.item_id
        FROM pos p CROSS JOIN ks JOIN win ON win.k = ks.k AND win.g = array_to_string(p.w[p.s:p.s + ks.k - 1], ' ')
        WHERE p.s + ks.k - 1 <= len(p.w)),
hw AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS x FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op7_decontamination", OP7_SQL)
def op7(spark, sf_dir):
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_packing")
def op2(spark, sf_dir):
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


@query("op9_toxicity")
def op9(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_secrets")
def op3(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op4_quality")
def op4(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_url_filter")
def op10(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op8_pseudonyms")
def op8(spark, sf_dir):
    return pseudonyms.report(table(spark, sf_dir, "documents"), key="a key of the caller")


@query("op1_fingerprints")
def op1(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op6_jaccard_join")
def op6(spark, sf_dir):
    return jaccard_join.link(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t
"""


@query("op13_radix_dedup", OP13_SQL)
def op13(spark, sf_dir):
    return radix_dedup.classes(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12(spark, sf_dir):
    return whitening.report(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
                             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark, sf_dir):
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))
