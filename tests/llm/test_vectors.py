"""Whitening, hard negatives and quality scores against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklume.llm import negatives, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x int, d int, n int"


def vector_table(spark, rows, parts=4):
    """Rows (vec_id, embedding, label) with columns named like the operators' own."""
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS).repartition(parts)


def some_vectors(seed=0, n=90, d=6):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=d) * np.arange(1, d + 1) / 9).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(n)]
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(0, 60, 2)]  # copies
    return rows


ODD = [
    (1000, None, 1), (1001, [0.1, None, 0.2, 0.1, 0.0, 0.3], 1), (1002, [float("nan")] * 6, 2), (1003, [float("inf")] + [0.0] * 5, 1),
    (1004, [3e38] + [0.0] * 5, 1), (1005, [], 1), (None, [0.5, -0.5, 0.25, 0.0, 0.1, 0.2], 0),
]


def covariance(x):
    centred = x - x.mean(0)
    return centred.T @ centred / len(x)


def test_singular_values_and_vectors():
    rng = np.random.default_rng(1)
    for case in range(120):
        d, n = int(rng.integers(1, 25)), int(rng.integers(1, 50))
        x = rng.integers(-50, 50, (n, d)).astype(float)
        if case % 5 == 1:
            x[:, 0] = 3
        elif case % 5 == 2:
            x = np.repeat(x[: max(1, n // 3)], 2, axis=0)
        elif case % 5 == 3:
            x = x * np.logspace(0, -8, d)
        elif case % 5 == 4:
            x = np.vstack([np.eye(d), -np.eye(d)]) * 7  # all values equal
        centred = x - x.mean(0)
        triangle = np.zeros((d, d))
        r = np.linalg.qr(centred, mode="r")
        triangle[: len(r)] = r
        want = np.zeros(d)
        values = np.linalg.svd(centred, compute_uv=False) ** 2
        want[: len(values)] = values
        diagonal, upper, _ = whitening.bidiagonal(triangle)
        assert np.abs(whitening.singular_squares(diagonal, upper) - want).max() <= 1e-12 * max(want[0], 1e-300)
        found, vectors, trace = whitening.directions(triangle, len(x), 4)
        scale = max(float(found[0]), 1e-300)
        assert np.abs(covariance(x) @ vectors.T - vectors.T * found).max() <= 1e-12 * scale
        some = vectors[found > 0]
        assert np.abs(some @ some.T - np.eye(len(some))).max(initial=0) < 1e-10
        assert trace == pytest.approx(np.trace(covariance(x)), abs=1e-9)


def test_small_singular_values_are_accurate():
    """A bidiagonal matrix with values from 1 to 1e-12: each to full relative accuracy, which no covariance would give."""
    diagonal, upper = np.logspace(0, -12, 13), np.logspace(0, -12, 13)[1:] * 0.5
    found = np.sqrt(whitening.singular_squares(diagonal, upper))
    assert np.prod(found / diagonal) == pytest.approx(1, rel=1e-13)  # the determinant
    back = np.zeros((13, 13))  # the inverse of a bidiagonal matrix in closed form: products without cancellation
    for i in range(13):
        back[i, i] = 1 / diagonal[i]
        for j in range(i + 1, 13):
            back[i, j] = -back[i, j - 1] * upper[j - 1] / diagonal[j]
    assert 1 / found[-1] == pytest.approx(np.linalg.norm(back, 2), rel=1e-12)


def by_hand(rows, k=4):
    """Whitening with NumPy's eigenvectors; components up to their sign."""
    usable = [(key, v) for key, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) and abs(c) < 1e18 for c in v)]
    out = {}
    for d in {len(v) for _, v in usable if v}:
        here = [(key, np.floor(256 * np.asarray(v, np.float64)).astype(np.int64)) for key, v in usable if len(v) == d]
        fit = np.unique(np.stack([x for _, x in here]), axis=0)
        n, sums = len(fit), fit.sum(0)
        values, axes = np.linalg.eigh(covariance(fit.astype(float)))
        values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
        for key, x in here:
            deviation = int(((n * x - sums) ** 2).sum())
            for i in range(len(values)):
                some = values[i] > 1e-12 * values[0]
                white = abs(float((x - sums / n) @ axes[:, i]) / np.sqrt(values[i])) if some else None
                share = values[i] / np.trace(covariance(fit.astype(float))) if values[0] > 0 else None
                out.setdefault((key, d, i + 1), []).append((n, deviation, white, share))
    return out


@pytest.mark.parametrize("blocks", [None, 400])
def test_whitening(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(whitening, "BLOCK_BYTES", blocks)  # many blocks and many triangles
    rows = some_vectors() + ODD + [(2000, [0.5, 0.25], 1), (2001, [0.5, -0.25], 1), (2001, [0.5, -0.25], 1)]
    found = whitening.whitened(vector_table(spark, rows, 12)).collect()
    got = {}
    want = by_hand(rows)
    by_n = {v[0][0]: key[1] for key, v in want.items()}
    for r in found:
        got.setdefault((r.vec_id, by_n[r.n], r.component), []).append((r.n, r.deviation, None if r.whitened is None else abs(r.whitened), r.explained))
    assert set(got) == set(want)
    for key, values in want.items():
        assert len(got[key]) == len(values)
        for a, b in zip(got[key], values, strict=True):
            assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None)
            assert a[2] is None or a[2] == pytest.approx(b[2], rel=1e-8, abs=1e-9)
            assert a[3] == pytest.approx(b[3], rel=1e-9, abs=1e-12)
    assert all(r.identity_error < 1e-9 for r in found)


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened(vector_table(spark, [(1, None, 1)]).where("vec_id = 0")).count() == 0
    assert whitening.whitened(vector_table(spark, ODD[:4])).count() == 0
    alone = whitening.whitened(vector_table(spark, [(1, [0.5, 0.5], 1)] * 3)).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 1, 0, None, None, None)] * 6
    large = whitening.whitened(vector_table(spark, [(i, [1e16 * i, 1.0], 1) for i in range(4)])).collect()
    assert {r.deviation for r in large} == {None} and max(r.identity_error for r in large) < 1e-9


def mined_by_hand(rows, every=5, positives=5, most=3):
    """All products of every anchor, sorted."""
    usable = [
        (key, label, [int(np.floor(256 * np.float64(c))) for c in v]) for key, v, label in rows
        if key is not None and label is not None and v is not None and all(c is not None and np.isfinite(c) and abs(c) < 1e16 for c in v)
    ]
    out = []
    for anchor in sorted({key for key, _, _ in usable if key % every == 0}):
        _, label, x = min(r for r in usable if r[0] == anchor)
        others = [(-sum(a * b for a, b in zip(x, y, strict=True)), key, lab) for key, lab, y in usable if key != anchor and len(y) == len(x)]
        near = sorted((s, key) for s, key, lab in others if lab == label)[:positives]
        for negated, positive in near:
            p = -negated
            inside = sorted((s, key) for s, key, lab in others if lab != label and 50 * p <= -100 * s <= 95 * p)[:most]
            out += [(anchor, positive, i + 1, key, p, -s) for i, (s, key) in enumerate(inside)]
    return sorted(out)


def mined(df, every=5):
    found = negatives.hard_negatives(df, F.col("vec_id") % every == 0)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


@pytest.mark.parametrize("shard", [None, 40])
def test_hard_negatives(spark, monkeypatch, shard):
    if shard:
        for name, value in (("SHARD_ROWS", shard), ("BLOCK_ROWS", 3), ("BOXES", 2)):
            monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] / 3 + rng.normal(size=6) / 9).astype(np.float32).tolist(), int(i % 3)) for i in range(240)]
    rows += [(240 + i, rows[i % 7][1], i % 2) for i in range(40)]  # ties
    rows += rows[3:5] * 2 + [(500, rows[0][1], 0)] * 60  # repeated rows
    rows += [(600, [0.5, 0.25], 1), (605, [0.5, 0.5], 1), (606, [0.25, 0.25], 0)]
    rows += [(key, v, label) for key, v, label in ODD if key != 1004] + [(700, rows[1][1], None)]
    found = mined(vector_table(spark, rows, 6))
    assert found == mined_by_hand(rows) and len(found) > 300


def test_hard_negatives_of_odd_tables(spark):
    assert mined(vector_table(spark, ODD[:4])) == []
    same = [(i, [0.5, 0.5], i % 2) for i in range(20)]  # nothing lies below 0.95 of a positive
    assert mined(vector_table(spark, same)) == mined_by_hand(same) == []
    zero = [(i, [0.0, 0.0], i % 2) for i in range(20)]
    assert mined(vector_table(spark, zero)) == mined_by_hand(zero) != []


def test_tree_prunes_and_loses_nothing():
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (12, 8))
    x = centres[rng.integers(0, 12, 900)] + rng.integers(-9, 9, (900, 8))
    labels, ids = rng.integers(0, 3, 900), np.arange(900)
    tree = negatives.Tree(x, labels, leaf=16)
    assert sorted(np.concatenate(tree.rows).tolist()) == ids.tolist()
    seen = []
    plain = negatives._products
    queries, own, label = x[:40], ids[:40], labels[:40]
    scores = plain(queries, x)
    bottom, top = negatives.bounds(queries, tree.low, tree.high)
    for node, rows in enumerate(tree.rows):
        assert (scores[:, rows] >= bottom[:, node : node + 1]).all() and (scores[:, rows] <= top[:, node : node + 1]).all()
    lows, highs = np.sort(rng.integers(-60000, 200000, (40, 2, 2)), axis=2).transpose(2, 0, 1)
    counted = negatives._leaf_scores
    try:
        negatives._leaf_scores = lambda *arguments: (scored := counted(*arguments), seen.append(len(scored)))[0]
        found = {(i, j): best for i, j, best in negatives.search(tree, ids, own, label, queries, lows, highs, False, 3)}
    finally:
        negatives._leaf_scores = counted
    for i in range(40):
        for j in range(2):
            want = sorted(((int(s), -key) for key, s in enumerate(scores[i].tolist()) if labels[key] != label[i] and lows[i, j] <= s <= highs[i, j]), reverse=True)[:3]
            assert found.get((i, j), []) == want
    assert sum(seen) < 0.5 * 40 * 900  # most rows are never scored
