"""Quality scores against the method's formulas, brute force and held-out labels."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklume.llm import quality
from tracklume.llm.text import LOWER_VALUES, mix, span_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def bins_by_hand(text):
    """One n-gram after the other."""
    data, step, whole = (text or "").encode(), 0x9E3779B97F4A7C15, (1 << 64) - 1
    out = set()
    for n in range(1, quality.LONGEST + 1):
        for i in range(len(data) - n + 1):
            x = ((int.from_bytes(data[i : i + n], "big") + (n << 40)) * step) & whole
            out.add((((x ^ (x >> 32)) * step) & whole) >> (64 - quality.BITS))
    words = [int(span_hashes(np.frombuffer(w, np.uint8), np.asarray([0]), LOWER_VALUES)[0]) for w in WORD.findall(data)]
    out |= {w >> (64 - quality.BITS) for w in words}
    for a, b in zip(words, words[1:]):
        out.add(int(mix(np.asarray([(a * step + b) & whole], np.uint64))[0]) >> (64 - quality.BITS))
    return sorted(out)


def test_bins_are_those_of_single_ngrams(rows):
    texts = [t for _, t, *_ in rows if t is None or len(t) < 3000][:60] + ["", "A", "a a", "é", " x "]
    for text, found in zip(texts, quality._bins(pa.array(texts, pa.string())), strict=True):
        assert found.tolist() == bins_by_hand(text)


def some_rows(seed=2, n=300, width=40):
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.7
    rows = []
    for y in good:
        at = np.unique(np.append(rng.integers(0, width, 6), width))
        values = np.where(at < width // 2, 1.0 if y else -0.5, 0.2) + rng.normal(size=len(at))
        rows.append((at, values))
    return rows, good


def test_descent_reaches_the_optimum():
    rows, good = some_rows()
    w, alpha = quality.dual_coordinate_descent(rows, good, 41, cost=2.0, epochs=500, gap=1e-6)
    y = np.where(good, 1.0, -1.0)
    upper = 2.0 * 0.5 / np.where(good, good.mean(), 1 - good.mean())
    assert ((alpha >= 0) & (alpha <= upper)).all()
    back = np.zeros(41)
    for (at, values), a, side in zip(rows, alpha, y, strict=True):
        back[at] += a * side * values
    assert np.abs(back - w).max() < 1e-9
    hinge = np.asarray([max(0.0, 1 - side * float(w[at] @ values)) for (at, values), side in zip(rows, y, strict=True)])
    primal, dual = w @ w / 2 + upper @ hinge, alpha.sum() - w @ w / 2
    assert 0 <= primal - dual < 1e-3 * primal  # both bound the optimum


def test_ratios_and_margins():
    sets = [np.asarray(s, np.int32) for s in ([1, 2], [1, 3], [1, 4], [4])]
    good = np.asarray([True, True, False, False])
    r = quality.log_count_ratios(sets, good)
    size = 1 << quality.BITS
    assert r[2] == pytest.approx(np.log((2 / (size + 4)) / (1 / (size + 3))))
    assert r[4] == pytest.approx(np.log((1 / (size + 4)) / (3 / (size + 3))))
    w = np.arange(size) % 7 - 3.0
    model = quality.Model((r * w).astype(np.float32), (r * r).astype(np.float32), bias=0.25)
    scaled = r[[1, 2]] * 1.0
    assert model.margins([sets[0]])[0] == pytest.approx(0.25 + float(w[[1, 2]] @ (scaled / np.linalg.norm(scaled))), rel=1e-5)
    assert model.margins([np.zeros(0, np.int32)])[0] == 0.25


def labelled(n=400, seed=6):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(5, 60))]
        poor = rng.random() < 0.25
        docs.append((i, " ".join(w + rng.choice(["***", "%%", "$$$"]) if poor else w for w in words)))
        labels.append((i, int(not poor)))
    return docs, labels


def test_held_out_texts(spark):
    docs, labels = labelled()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([(i, q) for i, q in labels if i % 4], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.scored(table, quality.fit(table, known)).collect()}
    assert len(found) == len(docs)
    right = [found[i].predicted == q for i, q in labels if i % 4 == 0]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())


def test_labels_that_do_not_teach(spark):
    """Conflicts, other values, repeated and null ids, ids without a document: as if they were not there."""
    docs, labels = labelled()
    table = spark.createDataFrame([*docs, (7, "zz"), (None, "*** %%")] + [(9, docs[9][1])] * 50, "doc_id long, text string")
    plain = spark.createDataFrame([r for r in docs if r[0] != 5] + [(7, "zz")], "doc_id long, text string")
    known = spark.createDataFrame([r for r in labels if r[0] != 5], "doc_id long, quality int")
    noisy = [*labels, (5, 1 - labels[5][1]), (6, labels[6][1]), (6, labels[6][1]), (None, 1), (8, None), (11, 7), (99999, 0)]
    one, two = quality.fit(table, spark.createDataFrame(noisy, "doc_id long, quality int")), quality.fit(plain.union(spark.createDataFrame([], plain.schema)), known)
    assert np.array_equal(one.scaled, two.scaled) and (one.bias, one.slope, one.level) == (two.bias, two.slope, two.level)


def test_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    scores = quality.scored(docs, model).collect()
    assert {r.score for r in scores} == {0.5} and {r.predicted for r in scores} == {0}
    assert len(scores) == docs.count() and scores[0].asDict()["key"] == 7
    assert quality.scored(empty, model).count() == 0
    good = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    share = quality.scored(docs.drop("score"), quality.fit(docs, good)).agg(F.min("score"), F.max("score")).first()
    assert share[0] == share[1] > 0.9
    with_both = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int"))
    odd = {r.doc_id: r.score for r in quality.scored(docs, with_both).collect()}
    assert odd[200] == odd[201]  # null and empty
