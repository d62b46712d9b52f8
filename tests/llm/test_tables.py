"""Personal data, mixing, nearest vectors and the pipeline."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracklume.llm import mixing, nearest, private

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans(spark):
    rng = random.Random(1)
    parts = ["a", "@", ".", "1", "2", "+", "-", " ", "_", "%", "(", ")", "255", "256", "9", "é", "😀", "4111111111111111", "\n", "a@b.c", "10.0.0.1", "+1 (255) 555-8013"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [None, "", "x@" + "b" * 20000 + " " + "1 " * 20000 + "y" * 50000 + "+1" + " " * 30000, "é a@b.c " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in private.base_spans(df).select("doc_id", private.listed(F.col("base")).alias("s"), private.masked(F.col("text"), F.col("base")).alias("m")).collect()}
    for i, text in enumerate(texts):
        assert found[i].s == base(text)
        if found[i].s == "":
            assert found[i].m == text


def test_masks(spark):
    df = spark.createDataFrame([("é +1 (255) 555-8013, a@b.co!",), ("4111111111111111",), ("none",)], "text string")
    found = [r.m for r in private.base_spans(df).select(private.masked(F.col("text"), F.col("base")).alias("m")).collect()]
    assert found == ["é [PHONE], [EMAIL]!", "[CARD]", "none"]


def test_contexts_discover_identifiers(spark, docs, empty):
    rows = [(i, f"hello Call me: +1 (255) 555-{8000 + i} now, or write to user{i}@mail.example thanks") for i in range(12)]
    rows += [(50, "Please call me: (255)555-9999."), (51, "or Write  to bob.at.home@local now"), (52, "the order 1234567 is late"), (53, None), (54, "call me: maybe"), (55, "write to 77")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_row": F.lit(1), "others": F.lit("x"), "added": F.lit(0), "tokens": F.lit(2)})
    found = {r.doc_id: r for r in private.personal_data(df).select("doc_id", "_row", "others", "tokens", private.listed(F.col("added")).alias("added")).collect()}
    assert found[50].added == "phone:17:29" and found[51].added == "email:13:30"
    assert [i for i, r in found.items() if r.added] == [50, 51] and found[52].others == "x" and found[52].tokens == 2
    assert len(found) == len(rows) and private.personal_data(empty).count() == 0
    assert private.personal_data(docs).where(F.size("added") > 0).count() == 0


def test_discovery_takes_more_than_one_round(spark):
    """An instance found by one pattern makes a second pattern known, which finds another."""
    rows = [(f"p{a}", f"i{b}", "phone") for a in range(1) for b in range(9)] + [("p0", "j0", None)]
    rows += [("p1", f"j{b}", None) for b in range(1)] + [("p1", f"i{b}", "phone") for b in range(6)] + [("p1", "k", None)]
    rows += [("noise", f"n{b}", None) for b in range(40)] + [("noise", "i1", "phone")]
    seen = spark.createDataFrame(rows, "pattern string, instance string, kind string")
    assert sorted(r.instance for r in private._discovered(seen, 1, 5, 0.8).collect()) == ["j0"]
    assert sorted(r.instance for r in private._discovered(seen, 2, 5, 0.8).collect()) == ["j0", "k"]


def test_spaced_and_long_identifiers_are_discovered(spark):
    rows = [(i, f"hello Call me: +1 (255) 555-{8000 + i} now, or write to user{i}@mail.example thanks, my card: 4111 1111 1111 1111 too") for i in range(24)]
    rows += [(i + 30, f"my card: {number}") for i, number in enumerate(["4111111111111111", "5500 0000 0000 0004", "3400 000000 00009 1", "6011-0000-0000-0004", "4012888888881881"])]
    planted = {
        50: ("call me: ", "555 123 4567", " now", "phone"), 51: ("call me: (", "555) 123-4567", ".", "phone"), 52: ("call me: ", "555 - 123 . 4567", ", ok", "phone"),
        53: ("write to ", "christopher.montgomery@intranet", "", "email"), 54: ("write to ", "a" * 70 + "@" + "b" * 70, " now", "email"),
        55: ("my card: ", "4111 1111 1111 1112", " x", "card"), 56: ("10.0.0.1 call me: ", "555 1234567", " 89x", "phone"), 57: ("write to ", "x@y", " now", "email"),
        58: ("call me: ", "1" * 30 + " 2" * 3000, "", "phone"),
        59: ("room ", "5551234567", " 20 is free", "phone"), 60: ("call me: ", "5551234567", " or not", "phone"),
    }
    rows += [(i, a + b + c) for i, (a, b, c, _) in planted.items()] + [(80, "7654321 10.0.0.1 7 654321 +1 (255) 555-8013, 1234567 2020 x1 12"), (81, "1 " * 30000 + "1x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.added for r in private.personal_data(df).select("doc_id", private.listed(F.col("added")).alias("added")).collect()}
    assert {i: found[i] for i in planted} == {i: f"{k}:{len(a)}:{len(a) + len(b)}" for i, (a, b, _, k) in planted.items()}
    tokens = {r.doc_id: [t.match for t in r.tokens] for r in private._tokens(private.base_spans(df.where("doc_id >= 80"))).select("doc_id", "tokens").collect()}
    assert tokens[80] == ["7 654321", "1234567 2020", "7654321", "654321", "1234567"] and tokens[81] == [("1 " * 30000)[:-1]]


def test_secrets_are_seeds_and_induce_patterns(spark):
    value = "".join(f"{i:x}" for i in range(16)) * 2
    forms = ['token = "{}" then', "my_api_key={} then", 'see {{"client-secret": "{}"}}', "password: {}", 'an auth.token="{}"### then']
    rows = [(i, form.format(f"{value}{i:04d}")) for i, form in enumerate(forms * 6)]
    places = {i: (text.index(value), len(value) + 4) for i, text in rows}
    rows += [(100, "token = 12345678901234"), (101, f"the value {value}0003 alone"), (102, "commit 0123456789abcdef0123456789abcdef01234567"), (103, "x=12345678 size = 1234567 token")]
    rows += [(104, f"padded {value}== here"), (105, "token = abc"), (106, f"monkey = {value}7777"), (107, f"token == {value}8888")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in private.personal_data(df).select("doc_id", private.listed(F.concat("base", "added")).alias("s"), private.masked(F.col("text"), F.concat("base", "added")).alias("m")).collect()}
    assert {i: found[i].s for i in places} == {i: f"secret:{a}:{a + n}" for i, (a, n) in places.items()}
    assert found[0].m == 'token = "[SECRET]" then' and found[4].m == 'an auth.token="[SECRET]"### then'
    assert found[100].s == "secret:8:22"  # digits alone are no seed; the pattern that the seeds induce finds them
    assert found[101].s == f"secret:10:{10 + len(value) + 4}"
    assert [i for i in range(102, 108) if found[i].s] == []


@pytest.mark.parametrize("patterns", [1, 3, 4, 20])
def test_discovery_keeps_what_many_patterns_vouch_for(spark, patterns):
    rows = [(f"p{a}", f"i{a}-{b}", "phone") for a in range(patterns) for b in range(9)] + [(f"p{a}", "new", None) for a in range(patterns)]
    seen = spark.createDataFrame(rows, "pattern string, instance string, kind string")
    assert [tuple(r) for r in private._discovered(seen, 3, 5, 0.75).collect()] == [("new", "phone")]


def raked(cells, goals, cycles=400):
    w = dict(cells)
    for _ in range(cycles):
        for side, goal in enumerate(goals):
            total = {}
            for key, v in w.items():
                total[key[side]] = total.get(key[side], 0) + v
            w = {key: v * goal[key[side]] / total[key[side]] for key, v in w.items()}
    return w


def test_mixing_matches_raking(docs, rows):
    found = mixing.calibrated(docs).collect()
    assert len(found) == len(rows) and found[0].key == 7 and found[0]._source == 7
    cells, marginal = {}, [{}, {}, {}]
    for r in found:
        key = (r.source or mixing.NONE, r.lang or mixing.NONE, r.topic)
        assert r.tokens == max(1, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
        cells[key] = cells.get(key, 0) + r.tokens
        for side in range(3):
            marginal[side][key[side]] = marginal[side].get(key[side], 0) + r.tokens
    goals = [mixing.flattened(m, 0.8) for m in marginal]
    want = raked(cells, goals)
    rate = {k: want[k] / cells[k] for k in cells}
    top = max(rate.values())
    for r in found:
        assert math.isclose(r.probability, rate[(r.source or mixing.NONE, r.lang or mixing.NONE, r.topic)] / top, rel_tol=1e-6)


def test_mixing_draws_by_hash(docs, empty, spark):
    rated = {r.doc_id: r.probability for r in mixing.calibrated(docs).collect()}
    drawn = {r.doc_id for r in mixing.sampled(docs.unionByName(docs.limit(0))).collect()}
    by_hash = {r.doc_id: r.u for r in docs.select("doc_id", mixing.uniform(F.col("doc_id")).alias("u")).collect()}
    assert drawn == {i for i, p in rated.items() if by_hash[i] < p} and 0 < len(drawn) < len(rated)
    assert mixing.sampled(empty).count() == 0
    share = spark.range(20000).agg(F.avg(mixing.uniform(F.col("id"))).alias("m")).first().m
    assert abs(share - 0.5) < 0.01
    one = spark.createDataFrame([(1, None, None, None)] * 4, "doc_id long, text string, lang string, source string")
    assert [r.probability for r in mixing.calibrated(one).collect()] == [1.0] * 4


def brute_top(rows, every, k):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in usable:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return {i: v for i, v in out.items() if v}


def found_top(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[i % 3][1]) for i in range(60)]  # ties
    rows += [(500, None), (505, [1.0, None]), (510, [float("nan")] * 6), (515, [float("inf")] * 6), (520, [0.5, 0.25]), (521, [3.0, -1.0]), (525, []), (None, [1.0] * 6)]
    rng.shuffle(rows)
    return rows


def test_top_k(spark, vectors, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 100)
    monkeypatch.setattr(nearest, "LEAF_ROWS", 8)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 10)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"n": F.lit(1), "shard": F.lit(2), "cells": F.lit("x")})
    assert found_top(nearest.top_k(df, F.col("vec_id") % 5 == 0, k=4)) == brute_top(vectors, 5, 4)
    assert nearest.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert nearest.top_k(df, F.col("vec_id") < 0).count() == 0


def test_tree_bounds_hold():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-300, 300, (700, 5))
    tree = nearest.Tree(vectors, 16)
    bounds = tree.bounds(vectors[:20])
    for node, (at, to) in enumerate(tree.span):
        assert (bounds[:, node] >= (vectors[:20] @ vectors[tree.order[at:to]].T).max(1)).all()
    assert sorted(tree.order) == list(range(700)) and max(b - a for (a, b), c in zip(tree.span, tree.children, strict=True) if c is None) <= 16


def test_large_scores_are_exact():
    a = np.asarray([[2**31, 3]], np.int64)
    assert nearest._exact_product(a, a).tolist() == [[2**62 + 9]]
    with pytest.raises(OverflowError):
        nearest._exact_product(np.asarray([[2**40]], np.int64), np.asarray([[2**40]], np.int64))


def test_pipeline(spark, rows, tmp_path):
    extra = [(900, "Mail bob@mail.example.com or +1 (255) 555-8013 the of and to in is that was for", "en", "s0", 0), (901, "1234 5678", None, None, 0)]
    path = str(tmp_path / "documents.parquet")
    table = [*rows, *extra, rows[0]]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = str(tmp_path / name)
        result = stage(spark, docs, str(tmp_path))
        assert result.columns == docs.columns
        result.write.parquet(out)
        docs = spark.read.parquet(out)
        steps[name] = {r.doc_id: r for r in docs.collect()}
    letters = {i for i, t, *_ in table if any(c.isalpha() for c in t or "")}
    assert set(steps["language"]) == letters
    assert all(r.lang for r in steps["language"].values())
    import test_texts

    kept = {i for i, (_, top) in test_texts.components([(r.doc_id, r.text) for r in steps["language"].values()], 5).items() if i == top}
    assert set(steps["near_duplicates"]) == kept and spark.read.parquet(str(tmp_path / "near_duplicates")).count() == len(kept)
    masked = steps["personal_data"]
    assert set(masked) == kept and masked[900].text == "Mail [EMAIL] or [PHONE] the of and to in is that was for"
    assert all(r.n_chars == len(r.text) for r in masked.values())
    assert all(base(r.text) == "" for r in masked.values())
    assert set(steps["mixing"]) < kept and steps["mixing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(steps["mixing"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in whole) == sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in packed)


def test_no_text_is_lost_where_ids_repeat(spark, empty):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcde")
    near = a.replace("a11", "x")  # 7 of 9 shingles of a
    rows = [(5, a), (5, b), (3, a), (9, c), (9, d), (None, e), (None, e), (None, c + " y"), (7, near), (8, None), (8, None), (8, ""), (1, "one two"), (1, "one two")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, row0 int").repartition(3)
    kept = [r.text for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()]
    assert sorted(t for t in kept if t) == sorted([a, b, kept[kept.index(c)] if c in kept else c + " y", d, e, near, "one two"])
    assert kept.count(None) == 2 and kept.count("") == 1
    assert corpus_pipeline.keep_one_of_each_group(spark, empty, "").count() == 0
