"""Radix deduplication, whitening and hard negatives against brute force, with nulls, repeats, ties and odd columns."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import hard_negatives as hn, radix_dedup, whitening as wh

LONG = "lorem ipsum " * 9000
TEXTS = [(5, None), (1, ""), (2, " "), (3, " \t\r\n\x0b\x0c "), (4, "a b"), (9, "a\n\nb"), (9, "a b"), (7, "a b "), (None, "a  b"), (None, "null id"),
         (8, LONG), (6, LONG), (10, LONG + "x"), (11, LONG[:-1] + " "), (12, "é 漢"), (13, "é  漢"), (14, "é 漢"),
         (4, "other text, same id"), (15, "x" * 32), (16, "x" * 32), (17, "x" * 31), (18, "x" * 33)]


def normal(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute_classes(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append(d)
    out = []
    for t, ids in groups.items():
        least = min((d for d in ids if d is not None), default=None)
        stays = ids.index(least)
        out += [(d, least, len(ids), k == stays, hashlib.sha256(t.encode()).hexdigest()) for k, d in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_radix_classes_match_a_dictionary(spark, parts):
    rows = TEXTS * 2 + [(100 + k, "hot \n text") for k in range(300)] + [(1000 + k, f"near {'same start ' * 8}{k}") for k in range(50)]
    docs = spark.createDataFrame([(d, t, "own", 1) for d, t in rows], "doc_id long, text string, head string, kept int").repartition(parts)
    # Small digits, so that several levels are shuffled.
    got = radix_dedup.classes(docs, digit=40, long=9000)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_classes(rows)


def test_radix_deduplicate_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(d, t, "own", k) for k, (d, t) in enumerate(TEXTS)], "doc_id long, text string, head string, row int").repartition(3)
    got = radix_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len({normal(t) for _, t in TEXTS})
    assert {(r.doc_id, r.text) for r in rows} <= set(TEXTS) and {normal(r.text) for r in rows} == {normal(t) for _, t in TEXTS}


def test_radix_groups_split_until_ended():
    texts = [b"", b"", b"a" * 70, b"a" * 70, b"a" * 69 + b"b", b"a" * 64, b"a" * 32, b"a" * 32, b"b"]
    got = sorted(sorted(g) for g in radix_dedup.radix_groups(texts))
    assert got == [[0, 1], [2, 3], [4], [5], [6, 7], [8]]
    assert radix_dedup.radix_groups([]) == []


def test_radix_memo_is_bounded_and_changes_nothing(spark, monkeypatch):
    rows = [(k, f"text {k % 7} " * 50) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(radix_dedup, "MEMO_BYTES", 600)
    assert sorted(map(tuple, radix_dedup.classes(docs).collect()), key=repr) == brute_classes(rows)


def test_radix_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert radix_dedup.classes(docs).count() == 0 and radix_dedup.deduplicate(docs).count() == 0


# --- whitening --------------------------------------------------------------------------------------------------------------


def vectors(spark, x, extra=()):
    rows = [(k, [float(v) for v in r], "own") for k, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string").repartition(3)


def brute_whiten(x, most=16):
    g = np.floor(64 * np.asarray(x, dtype=np.float32).astype(float)).astype(np.int64) + 1000000
    u = np.unique(g, axis=0)
    n, s = len(u), u.sum(axis=0)
    value, vector = np.linalg.eigh(((u * n - s) / n).T @ ((u * n - s) / n) / n)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    return n, ((g * n - s)**2).sum(axis=1), ((g * n - s) / n) @ vector / np.sqrt(value), value / np.trace(((u * n - s) / n).T @ ((u * n - s) / n) / n)


@pytest.mark.parametrize("block", [1, 3, 16])
def test_whitening_matches_an_eigensolver(spark, block):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal((120, 20)) * np.linspace(3, 0.5, 20)] * 2)  # every point twice
    bad = [(900, None, "n"), (901, [], "e"), (902, [float("nan")] * 20, "f"), (903, [1.0] * 19 + [None], "g"), (904, [1.0] * 19 + [float("inf")], "h")]
    got = wh.report(vectors(spark, x, bad), block=block).toPandas()
    n, deviation, whitened, explained = brute_whiten(x)
    assert len(got) == 240 * 16 and set(got.n) == {n} and n == 120
    by = got.pivot(index="vec_id", columns="component", values="whitened").values
    assert np.abs(np.abs(by) - np.abs(whitened)).max() < 1e-9
    assert (got[got.component == 1].sort_values("vec_id").deviation.values == deviation).all()
    assert np.allclose(got.groupby("component").explained.first().values, explained, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


def test_repeated_eigenvalues_and_missing_directions(spark):
    # A cross of points: all variances equal in four directions, none in a fifth.
    x = [[2.0 * s * (i == j) for j in range(4)] + [7.0] for i in range(4) for s in (1, -1)]
    for block in (1, 2, 16):
        got = wh.report(vectors(spark, x), block=block).toPandas()
        assert set(got.component) == {1, 2, 3, 4}
        assert np.allclose(got.explained, 0.25) and got.identity_error.iloc[0] < 1e-12
        w = got.pivot(index="vec_id", columns="component", values="whitened").values
        assert np.allclose(w.T @ w / len(x), np.eye(4))


def test_more_dimensions_than_needed_stop_early(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 200)) * np.concatenate((np.geomspace(100, 10, 16), np.full(184, 0.1)))
    rows = vectors(spark, x).select("vec_id", wh.grid(F.col("embedding"), 64, 1000000).alias("x"))
    passes = []
    product = wh._Bidiagonal._product
    try:
        wh._Bidiagonal._product = lambda self, make, *small: passes.append(1) or product(self, make, *small)
        model = wh.fit(rows)
    finally:
        wh._Bidiagonal._product = product
    assert len(passes) < 2 * 200 / 16
    assert np.allclose(model.variance / model.total, brute_whiten(x)[3], rtol=1e-9) and model.identity_error < 1e-9


def test_whitening_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert wh.report(none).count() == 0
    assert wh.report(vectors(spark, [[1.0, 2.0]] * 5)).count() == 0
    with pytest.raises(ValueError, match="several lengths"):
        wh.report(vectors(spark, [[1.0, 2.0], [3.0]]))


def test_deviation_is_exact_beyond_64_bits():
    x = np.array([[3 * 10**6, 5]], dtype=np.int64)
    got = wh._shifted(x, 10**13, np.array([7, 9], dtype=np.int64))
    assert got.tolist() == [[3 * 10**19 - 7, 5 * 10**13 - 9]]


# --- hard negatives ---------------------------------------------------------------------------------------------------------


def brute_negatives(rows, anchor):
    """Rows are distinct (id, label, x)."""
    rows = [r for r in dict.fromkeys(rows) if None not in r[:2] and r[2]]
    out = set()
    for i, label, x in rows:
        if not anchor(i):
            continue
        dot = [(-sum(a * b for a, b in zip(x, r[2])), r[0], r[1]) for r in rows if r[0] != i]
        for p, pid, _ in sorted(d for d in dot if d[2] == label)[:5]:
            some = sorted(d for d in dot if d[2] != label and 80 * -p <= 100 * -d[0] <= 100 * -p)[:5]
            out |= {(i, pid, k + 1, nid, -p, -s) for k, (s, nid, _) in enumerate(some)}
    return out


@pytest.mark.parametrize("spread", [0.0, 0.3])
def test_negatives_match_brute_force(spark, spread):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((6, 8))
    x = np.floor(64 * (centres[rng.integers(0, 6, 700)] + spread * rng.standard_normal((700, 8)))).astype(int)
    rows = [(int(k), int(rng.integers(0, 4)), tuple(map(int, v))) for k, v in enumerate(x)]
    rows += rows[:50] + [(k, 1, rows[3][2]) for k in range(1000, 1100)]  # repeated rows, one very common vector
    rows += [(20, 2, rows[9][2]), (None, 1, rows[0][2]), (7000, None, rows[0][2]), (7010, 1, ()), (7020, 9, rows[5][2])]
    df = spark.createDataFrame([(i, lab, list(v), "own") for i, lab, v in rows], "id long, label int, x array<long>, score string").repartition(4)
    got = hn.mine(df, F.col("id") % 10 == 0, sample=100, shard=90, leaf=4, chunk_bytes=2000)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_large_integers_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(k, k % 2, tuple(int(v) for v in rng.integers(-2**29, 2**29, 4))) for k in range(60)]
    df = spark.createDataFrame([(i, lab, list(v)) for i, lab, v in rows], "id long, label int, x array<long>")
    assert {tuple(r) for r in hn.mine(df, F.col("id") % 10 == 0).collect()} == brute_negatives(rows, lambda i: i % 10 == 0)
    with pytest.raises(ValueError, match="too large"):
        hn.mine(spark.createDataFrame([(0, 1, [1 << 32])], "id long, label int, x array<long>"), F.col("id") == 0)


def test_negatives_of_odd_tables(spark):
    assert hn.report(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    odd = [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2), (100, None, 1), (200, [float("nan"), 1.0], 1), (300, [1.0, None], 1), (400, [], 1),
           (500, [1.0, 1.0], None), (600, [1.0, 1.0], 3)]
    got = hn.report(spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int"))
    # ids divisible by 7 change their label: 0 gets 2; all zero vectors score 0 with each other, 600 has no other row of its label.
    assert {tuple(r) for r in got.collect()} == {(0, 2, 1, 1, 0, 0), (0, 2, 2, 600, 0, 0)}
    with pytest.raises(ValueError, match="several lengths"):
        hn.report(spark.createDataFrame([(0, [1.0], 1), (1, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int"))


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(1)
    x = np.floor(100 * (rng.standard_normal((8, 5))[rng.integers(0, 8, 500)] + 0.05 * rng.standard_normal((500, 5)))).astype(np.int64)
    rows = hn.augmented(x, int(np.square(x).sum(axis=1).max()))
    tree = hn.build(rows, leaf=4)
    assert sorted(tree.order) == list(range(500))
    for k in range(len(tree.centre)):
        inside = tree.order[tree.start[k]:tree.end[k]]
        assert np.sqrt(np.square(rows[inside] - rows[tree.centre[k]]).sum(axis=1)).max() <= tree.radius[k] + 1e-9
        children = np.arange(tree.first[k], tree.last[k])
        assert not len(children) or sorted(np.concatenate([tree.order[tree.start[j]:tree.end[j]] for j in children])) == sorted(inside)
    looked = []
    verify = hn._verify
    try:
        hn._verify = lambda ask, best, who, score, ids, labels: looked.append(score.size) or verify(ask, best, who, score, ids, labels)
        ask = hn.Questions(x[:1], np.array([0]), np.array([0]), np.array([-1]), True, np.array([-1 << 60]), np.array([1 << 60]), 3)
        best = hn._Best(1, 3)
        hn.descend(tree, x, np.arange(500), np.zeros(500, dtype=np.int64), ask, best, np.array([0]))
    finally:
        hn._verify = verify
    assert best.score[0].tolist() == sorted((x @ x[0]).tolist())[::-1][:3]
    assert sum(looked) < 250
