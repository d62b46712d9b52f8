import random

import pytest
from pyspark.sql import functions as F

WORDS = {
    "en": "the of and to in is that was for with on are by this from they which one have had".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "es": "de la que el en los del se las por un para con una su al lo como más pero".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "al", "er", "ing", "os"]) for _ in range(n))


def corpus(seed=0, n=120):
    """Random texts with copies, near copies and shared passages, and the awkward ones: null, empty, white space, long."""
    rng = random.Random(seed)
    rows = []
    shared = passage(rng, 60)
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = passage(rng, rng.choice([1, 2, 3, 5, 19, 20, 21, 60, 150]), lang)
        if rng.random() < 0.2:
            text = f"{text}\n{shared[rng.randrange(60):]}  {text[:50]}"
        rows.append([i, text, lang, f"s{min(i % 7, 3)}"])
    for i in range(n, n + 40):
        words = rng.choice(rows[:n])[1].split(" ")
        if i % 2 and len(words) > 3:
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append([i, " ".join(words), "en", "s0"])
    base = passage(rng, 120).split(" ")
    for i in range(n + 40, n + 80):  # a group in which many pairs lie around the bound
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"y{rng.randrange(30)}"
        rows.append([i, " ".join(words), "en", "s0"])
    odd = [None, "", " \t\n ", "é", "ÀB ß x", "<|endoftext|> a", "a", "A", passage(rng, 6000, "es"), "w" * 30000, "the " * 3000]
    rows += [[n + 80 + i, text, None if i % 2 else "en", None if i % 3 else "s9"] for i, text in enumerate(odd)]
    rng.shuffle(rows)
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({c: F.lit(7) for c in ("key", "target", "_key", "_row", "_text", "_source", "others", "shard", "label", "rep", "turn", "base", "score")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
