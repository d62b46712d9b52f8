"""Fingerprints, near-duplicates, passages, languages, licenses against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tracklume.functions import skew
from tracklume.llm import fingerprint, language, licenses, linked, neardup, passages, text
from tracklume.llm.linked import smallest_of_component

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(rows, size):
    sets = {r[0]: shingles(r[1], size) for r in rows}
    label = {i: i for i in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def found_components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_near_duplicates(docs, rows):
    found = neardup.near_duplicates(docs, size=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_in_small_tasks(docs, rows, monkeypatch):
    # every key and every group is larger than a task may take; the closures below are pickled with these values
    monkeypatch.setattr(neardup, "KEY_ROWS", 4)
    monkeypatch.setattr(neardup, "GROUP_SHINGLES", 500)
    monkeypatch.setattr(neardup, "PART_SHINGLES", 400)
    assert found_components(neardup.near_duplicates(docs, size=4)) == components(rows, 4)


def test_links_of_a_group_in_parts_are_those_of_all_pairs(spark, monkeypatch):
    # families that only one group ties together, and chains whose ends share little: most documents are not tied to any one of them
    rng = random.Random(8)
    rows = []
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(60)]
        for _ in range(25):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[rng.randrange(60)] = f"n{len(rows)}"
    rows.append((len(rows), "alone"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = neardup.signed(docs, 4).withColumnRenamed("doc_id", "rep")
    groups = sets.selectExpr("rep", "0L as label")
    expected = components(rows, 4)
    for part_rows, shingles_of_block in ((8, 300), (8, 8_000_000), (50, 2000), (1000, 8_000_000)):
        monkeypatch.setattr(neardup, "PART_ROWS", part_rows)
        monkeypatch.setattr(neardup, "GROUP_SHINGLES", shingles_of_block)
        links = neardup.confirmed_links(docs, groups, sets, 4, 80)
        label = {r.node: r.label for r in smallest_of_component(links).collect()}
        assert {i: label.get(i, i) for i, _ in rows} == {i: top for i, (_, top) in expected.items()}


def test_groups_below_the_limit_make_no_list_of_large_ones(spark, monkeypatch):
    written, store = {}, neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, name: written.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or store(df, name))
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in range(20 + i % 2))) for i in range(6)], "doc_id long, text string")
    sets = neardup.signed(docs, 4).withColumnRenamed("doc_id", "rep")
    links = neardup.confirmed_links(docs, sets.selectExpr("rep", "0L as label"), sets, 4, 80)
    assert {r.node: r.label for r in smallest_of_component(links).collect()} == {i: 0 for i in range(1, 6)}
    assert "_ways" not in written["sized"] and "_ways" not in written["texts"]


def test_pairs_that_meet_in_one_hot_key_only(spark):
    # a family larger than KEY_ROWS that shares one band; partners agree in three of the four registers of every other band
    n = neardup.KEY_ROWS + 808
    regs = np.random.default_rng(6).integers(1, 1 << 16, (n, 32, 4)).astype(np.uint16)
    regs[1::2, 1:, :3] = regs[::2, 1:, :3]
    regs[:, 0] = 7
    reps = spark.createDataFrame([(i, 1000, r.tobytes()) for i, r in enumerate(regs)], "rep long, n_shingles long, regs binary")
    found = {r.rep: r.label for r in neardup.likely_groups(reps, 80).collect()}
    assert found == {i: i // 2 * 2 for i in range(n)}


def test_near_duplicates_of_odd_tables(spark, empty):
    assert neardup.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (8, "A B c d e f"), (9, None), (10, " ")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in found), key=str) == sorted(
        [(None, None, True), (5, 5, True), (5, 5, True), (8, 5, False), (9, 9, True), (10, 10, True)], key=str
    )


def test_link_forest_links_as_all_pairs_do():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 40)).astype(np.uint64)) for _ in range(120)]
    label = list(range(len(sets)))

    def merge(pairs):
        group = list(label)
        for a, b in pairs:
            x, y = group[a], group[b]
            group = [x if g == y else g for g in group]
        return [group.index(g) for g in group]

    every = [
        (a, b) for a in range(120) for b in range(a) if len(sets[a]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))
    ]
    forest = neardup._link_forest(sets, 60)
    assert merge(forest) == merge(every) and len(forest) < 120 and set(map(tuple, map(sorted, forest))) <= set(map(tuple, map(sorted, every)))


def test_estimate_is_close_and_corrected():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (4000, 1000, 1000))
    one, two = (neardup.registers(np.unique(np.concatenate([common, x]))) for x in (a, b))
    share = (one == two).mean()
    assert abs(share - 4000 / 6000) < 0.2
    assert neardup.likely(one, 5000, two[None], np.asarray([5000.0]), 0.6)[0]
    far = neardup.registers(np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64)))
    assert not neardup.likely(one, 5000, far[None], np.asarray([5000.0]), 0.8)[0]
    assert 0 < neardup.chance_collisions(np.float64(5000), np.float64(5000)) < 1


def test_components_of_long_chains(spark):
    rng = random.Random(0)
    order = list(range(300))
    rng.shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(299) if i % 50] + [(1000, 1001), (1001, 1002)]
    found = {r.node: r.label for r in smallest_of_component(spark.createDataFrame(links, "a long, b long")).collect()}
    for at in range(0, 300, 50):
        chain = order[at + 1 : at + 51]
        assert all(found.get(x, x) == min(chain) for x in chain)
    assert found[1002] == found[1001] == 1000


def test_components_end_where_all_links_are_stars(spark, monkeypatch):
    written, store = [], linked.stored
    monkeypatch.setattr(linked, "stored", lambda df, name: written.append(name) or store(df, name))

    def found(links):
        written.clear()
        return {r.node: r.label for r in smallest_of_component(spark.createDataFrame(links, "a long, b long")).collect()}

    # stars around their smallest nodes, links twice, both ways round, to the node itself and to none: no star is made anew
    assert found([(1, 5), (5, 1), (1, 5), (7, 1), (2, 3), (4, 4), (None, 9), (8, None)]) == {5: 1, 7: 1, 3: 2}
    assert len(written) == 1
    assert found([(4, 4), (None, 1)]) == found([]) == {}
    # one round, and none to see that nothing changes; a centre that is not the smallest, a node with two centres, a path
    for links in ([(9, 1), (9, 2), (9, 3)], [(2, 4), (1, 4)], [(1, 2), (2, 3)]):
        assert found(links) == {x: 1 for link in links for x in link if x != 1}
        assert len(written) == 3


def test_rounds_of_components_send_no_tables(spark, monkeypatch):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000, i) for i in range(1001, 1060)]
    written, store = [], linked.stored
    monkeypatch.setattr(linked, "stored", lambda df, name: written.append(df) or store(df, name))
    found = {r.node: r.label for r in smallest_of_component(spark.createDataFrame(links, "a long, b long")).collect()}
    top = {x: x for link in links for x in link}
    for _ in top:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    assert found == {x: t for x, t in top.items() if x != t}
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in written]
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
    # where a node may have more links than the limit, the links of such nodes are salted as before
    monkeypatch.setattr(skew, "HOT_ROWS", 7)
    written.clear()
    assert {r.node: r.label for r in smallest_of_component(spark.createDataFrame(links, "a long, b long")).collect()} == found
    assert any("_ways" in df._jdf.queryExecution().executedPlan().toString() for df in written)


def without_repeats(rows):
    seen, out = set(), {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        out[doc_id] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def test_repeated_passages(docs, rows):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in passages.without_repeats(docs).collect()}
    want = without_repeats(rows)
    assert found == want and sum(n for _, n, _ in want.values()) > 1000


def test_repeated_passages_of_odd_tables(spark, empty):
    assert passages.without_repeats(empty).count() == 0
    words = " ".join(f"w{i}" for i in range(25))
    rows = [(None, words), (3, f"{words} {words}"), (4, None), (4, "a")]
    found = {(r.doc_id, r.n_words): (r.n_removed, r.kept) for r in passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(None, 25): (0, words), (3, 50): (50, ""), (4, 0): (0, ""), (4, 1): (0, "a")}


def test_repeated_passages_of_rows_without_own_id(spark):
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(30)) for x in "abcde")
    rows = [(1, a), (1, a), (2, a), (2, a), (3, f"{b} {b}"), (3, f"{b} {b}"), (None, f"{c} {c}"), (None, d), (None, d), (None, "x"), (4, e), (4, b), (4, f"x {d}"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = [tuple(r) for r in passages.without_repeats(df).collect()]
    want = [(1, 30, 0, a)] * 2 + [(2, 30, 30, "")] * 2 + [(3, 60, 30, b)] * 2 + [(None, 60, 30, c), (None, 30, 0, d), (None, 30, 0, d), (None, 1, 0, "x")]
    want += [(4, 30, 0, e), (4, 30, 30, ""), (4, 31, 30, "x"), (4, 0, 0, "")]
    assert sorted(found, key=str) == sorted(want, key=str)
    shared = [(None, f"{a} {x}") for x in (b, c, d, e)]
    left = sorted(r.kept for r in passages.without_repeats(spark.createDataFrame(shared, "doc_id long, text string")).collect())
    assert sum(x.startswith(a) for x in left) == 1 and sum(r in left for r in (b, c, d, e)) == 3


def test_cover_is_a_difference_cover():
    assert {(a - b) % passages.PERIOD for a in passages.COVER for b in passages.COVER} == set(range(passages.PERIOD))
    assert passages.ANCHOR + passages.PERIOD - 1 == passages.WINDOW


def plain_sketch(text, k, size, entries):
    """Order MinHash by its definition, with the operator's own hash values."""
    points = fingerprint.points_of(text)
    kmers = fingerprint.kmers_of(points, k)
    width = min(k, len(text))
    seen, numbered = Counter(), []
    for i in range(len(kmers)):
        word = text[i : i + width]
        h = kmers[i : i + 1]
        if seen[word]:
            h = fingerprint.mix(h + np.asarray([seen[word]], np.uint64) * fingerprint._STEP)
        numbered.append(int(h[0] >> np.uint64(32)))
        seen[word] += 1
    out = []
    for factor in fingerprint._factors(entries).tolist():
        least = sorted(range(len(numbered)), key=lambda i: (numbered[i] * factor % (1 << 32), i))[:size]
        out.append(tuple(text[i : i + width] for i in sorted(least)))
    return out


def test_order_minhash_selects_by_definition():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé ") for _ in range(n)) for n in (1, 5, 9, 30, 200, 400) for _ in range(3)]
    texts += [texts[-1][200:] + texts[-1][:200], texts[-1] + "x"]
    sketches = [fingerprint.sketch(fingerprint.kmers_of(fingerprint.points_of(t), 4), 2, 32) for t in texts]
    tuples = [plain_sketch(t, 4, 2, 32) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            same = [x == y for x, y in zip(tuples[a], tuples[b], strict=True)]
            assert (sketches[a] == sketches[b]).tolist() == same


def test_fingerprints(docs, rows):
    found = {r.doc_id: r for r in fingerprint.fingerprints(docs, parts=6).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    texts = [t or "" for _, t, *_ in ordered]
    sketch = {t: fingerprint.sketch(fingerprint.kmers_of(fingerprint.points_of(t))) for t in texts}
    for i, (doc_id, *_) in enumerate(ordered):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        other = fingerprint.sketch(fingerprint.kmers_of(fingerprint.points_of(edited)))
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.written(sketch[text]), fingerprint.written(other))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(sketch[text], other), fingerprint.likeness(sketch[text], sketch[following]))


def test_fingerprints_of_odd_tables(spark, empty):
    assert fingerprint.fingerprints(empty).count() == 0
    rows = [(None, "no id"), (4, "four"), (4, "for"), (6, None)]
    found = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), parts=3).collect()
    assert sorted(r.n_chars for r in found) == [0, 3, 4, 5]
    alone = fingerprint.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and alone[0].near_next == 1.0


def test_language_is_recognised(docs, rows, empty):
    labelled = docs.where("doc_id < 120 and doc_id % 3 <> 0")  # later ones carry labels that are not theirs
    model = language.fit(labelled, per_language=30, landmarks=10)
    assert model.languages == ["de", "en", "es"]
    found = {r.doc_id: r for r in language.predicted(docs, model).collect()}
    assert found[rows[0][0]].key == 7 and set(docs.columns) < set(found[0].asDict())
    right = [found[i].lang_pred == lang for i, text, lang, *_ in rows if i < 120 and i % 3 == 0 and len(text) > 40 and "\n" not in text]
    assert len(right) > 10 and np.mean(right) > 0.95
    for doc_id, text, *_ in rows:
        letters = any(c.isalpha() for c in text or "")
        assert (found[doc_id].lang_pred == "und") == (not letters) and 0 <= found[doc_id].score <= 1
    none = language.fit(empty)
    assert {r.lang_pred for r in language.predicted(docs, none).collect()} == {"und"}
    assert language.predicted(empty, model).count() == 0


def test_language_matches_the_kernel_form(docs, rows):
    """Scores equal those of the kernel with the landmarks, without the folding of weights."""
    texts = [t for _, t, *_ in rows if t and any(c.isalpha() for c in t)][:20]
    flags = np.zeros(1 << language.BITS, bool)
    sets = [set(language.bins_of(t, flags).tolist()) for t in texts]
    kernel = np.asarray([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    assert np.allclose(np.diag(kernel), 1) and np.linalg.eigvalsh(kernel).min() > -1e-9
    assert not flags.any()


def test_junk_and_unlearned_languages_are_rejected(spark):
    from conftest import SCHEMA, WORDS, passage

    rng = random.Random(8)
    rows = [(i, passage(rng, 60, lang), lang, "s0", 0) for i, lang in enumerate(list(WORDS) * 30)]
    short = ["the of and", "der die und", "de la que el en los", "with", *[passage(rng, n, lang) for n in (2, 4, 8, 30) for lang in WORDS]]
    mixed = [f"{passage(rng, 20, 'en')} {passage(rng, 20, 'de')}"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    strange = ["".join(rng.choice(letters) for _ in range(300)), " ".join("".join(rng.choice(letters) for _ in range(7)) for _ in range(50))]
    strange += ["".join(rng.choice("0123456789abcdef") for _ in range(600)), "".join(rng.choice(letters + letters.upper() + "0123456789+/") for _ in range(600))]
    strange += ["съешь же ещё этих мягких французских булок да выпей чаю " * 3, "pchnąć w tę łódź jeża lub ośm skrzyń fig zażółć gęślą jaźń każdy człowiek rodzi się wolny i równy pod względem swej godności"]
    texts = [(1000 + i, text, None, "s0", 0) for i, text in enumerate(short + mixed + strange)]
    docs = spark.createDataFrame(rows + texts, SCHEMA)
    found = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()}
    assert found == {r[0] for r in rows} | {1000 + i for i in range(len(short + mixed))}


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= lcs(a, b)
        assert bool(pairs) == bool(set(a) & set(b))
        repeated = [x % 2 for x in a], [0, 1, 0, 1] + [x % 2 for x in b]
        assert len(licenses.aligned(*repeated)) <= lcs(*repeated)
    assert [j for _, j in licenses.aligned([1, 2, 3, 4], [9, 1, 9, 3, 4, 2])] == [1, 3, 4]
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_template_is_found_alone(spark, name):
    text = licenses.TEMPLATES[name]
    words = text.split(" ")
    damaged = " ".join(words[: len(words) // 2] + words[len(words) // 2 + 1 :]) if len(words) > 11 else text
    rows = [(1, f"foo bar. {text} the of and"), (2, f"x\n# {text.upper()}\n" + "a b " * 30 + f"\n{text}"), (3, damaged), (4, None), (5, ""), (6, "under the version of this")]
    found = licenses.license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.license for r in found if r.doc_id == 1] == [name] and [r.license for r in found if r.doc_id == 2] == [name] * 2
    assert [r.license for r in found if r.doc_id == 3] == [name] and not [r for r in found if r.doc_id > 3]
    assert all(0.8 <= r.coverage <= 1 and r.matched <= r.stop - r.start for r in found)


def test_no_notice_in_plain_texts(docs, empty):
    assert licenses.license_notices(docs).count() == 0
    assert licenses.license_notices(empty).count() == 0
    assert licenses.license_notices(docs, templates={}).count() == 0


@pytest.mark.parametrize(
    "text, names",
    [
        ("Released under the BSD License", ["BSD-line"]),
        ("Released under the Apache License", []),
        ("Released under the GPL License", []),
        ("Released under the MIT", ["MIT"]),
        ("Licensed under CC BY 4.0", ["CC-BY-4.0-line"]),
        ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]),
        ("Licensed under CC BY-NC-ND 4.0", ["CC-BY-NC-ND-4.0"]),
        ("Licensed under CC BY-SA 3.0", []),
        ("This work is licensed under the GNU General Public License, version 2. See section 3", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 2", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 1", []),
        ("This work is licensed under the GNU Lesser General Public License, version 3", ["LGPL-3.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1", []),
        ("Licensed under the Apache License, Version 1.1", []),
        ("Licensed under the Apache License 2.0. Build 1.0", ["Apache-2.0"]),
        ("Licensed under the Apache Software License, Version 2.0", ["Apache-2.0"]),
        ("Released under the BSD License. Released under the MIT License.", ["BSD-line", "MIT"]),
        ("Licensed under CC BY 4.0 or licensed under CC BY-NC 4.0", ["CC-BY-4.0-line", "CC-BY-NC-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", []),
    ],
)
def test_short_notices_need_their_deciding_words(spark, text, names):
    found = licenses.license_notices(spark.createDataFrame([(1, f"x y. {text}, the of")], "doc_id long, text string")).collect()
    assert [r.license for r in sorted(found, key=lambda r: r.start)] == names


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_scattered_words_are_no_notice(spark, name):
    """All words of a notice in order, with foreign words between, in a very long text; and the notice itself behind them."""
    rng = random.Random(3)
    words = licenses.TEMPLATES[name].split(" ")
    spread = " ".join(f"{w} " + " ".join(f"z{rng.randrange(99)}" for _ in range(rng.randrange(10, 16))) for w in words)
    texts = [spread, " ".join([spread] * 20), f"{spread} {licenses.TEMPLATES[name]} {spread}"]
    found = licenses.license_notices(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license) for r in found] == [(2, name)]
    assert found[0].matched >= 0.5 * (found[0].stop - found[0].start)


def test_densest_run_by_hand():
    rng = random.Random(4)
    for _ in range(300):
        places = sorted(rng.sample(range(40), rng.randrange(1, 16)))
        pairs = list(enumerate(places))
        found = licenses.densest(pairs)

        def score(run):
            return 2 * len(run) - (run[-1][1] - run[0][1] + 1)

        assert score(found) == max(score(pairs[a:b]) for a in range(len(pairs)) for b in range(a + 1, len(pairs) + 1))
        inside = [(a, b) for a, b in licenses.dense_stretches(places) if places[a] <= found[0][1] and found[-1][1] <= places[b - 1]]
        assert len(inside) == 1 or max(found[i + 1][1] - found[i][1] for i in range(len(found) - 1)) > licenses.SLACK


def twins_of_a_weak_hash(k):
    """A string over two letters and its complement that collide under any polynomial hash modulo 2 ** 64 once it is long enough."""
    bits = [bin(i).count("1") % 2 for i in range(1 << k)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_have_no_polynomial_structure(spark):
    pairs = [twins_of_a_weak_hash(k) for k in range(3, 13)]
    for pair in pairs:
        assert len(set(text.word_hashes(pa.array(pair))[0].tolist())) == 2
    one, two = twins_of_a_weak_hash(10)
    docs = spark.createDataFrame([(0, one), (1, two), (2, one)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, size=4, percent=80).collect()}
    assert found == {0: 0, 1: 1, 2: 0}
    # 20 words of two kinds in the same two orders, and two words that collide under a polynomial
    filler = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(0, f"{one} {filler}"), (1, f"{two} {filler}"), (2, f"{one} {filler}")], "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in passages.without_repeats(docs).collect()}
    assert found == {0: 0, 1: 0, 2: 20}
