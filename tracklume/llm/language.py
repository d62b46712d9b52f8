"""Language of a text by a string kernel and ridge regression.

Two texts are as similar as the share of n-grams (``n`` = 1 to 4 letters, over lower-cased letters with every other run as a gap)
that occur in both: the blended-spectrum presence kernel ``k(x, y) = |X and Y| / sqrt(|X| |Y|)``.  N-grams are hashed into
``2 ** BITS`` bins.  A bounded sample of labelled texts gives the landmarks and the rows of the fit.  With the landmark kernel matrix
``K = Z L Z'``, a text maps to ``k(x, landmarks) Z L^(-1/2)`` (Nystroem), and one ridge regression per language against the
rest is solved there.  The kernel of a text with the landmarks is linear in its presence vector, so landmarks, map and regression
weights are multiplied once into one matrix (bins x languages); scoring a batch is a sparse presence matrix times it.

The scores of all languages sum to 1 for any text, so they cannot tell a text that is in none.  That is told by the share of its n-grams
that the sample has: the bound lies halfway between the median share of a sample text in the other texts, and its median share in the texts of the
other languages, which stand for one that was not learned.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklume.llm.text import blocks

BITS = 18
LONGEST = 4
UNDETERMINED = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def bins_of(text: str, flags: np.ndarray) -> np.ndarray:
    """Bins of the n-grams present in a text; empty if it has no letter.  ``flags``: a scratch array, all false."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 0)
    stays = letter.copy()
    stays[1:] |= letter[:-1]  # one gap after each run of letters
    points = np.concatenate([[0], points[stays], [0]]).astype(np.uint64)
    grams = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(points) < n:
            break
        grams = grams[: len(points) - n + 1] * _STEP + points[n - 1 :] + np.uint64(1)
        mixed = grams ^ (grams >> np.uint64(32))
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        flags[(mixed >> np.uint64(64 - BITS)).astype(np.int64)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # bins x languages
    bias: np.ndarray
    known: np.ndarray | None = None  # bins that the sample has
    least: float = 0.0  # share of known bins from which a text is in a learned language


def _known(sets: list[np.ndarray], languages: list[str]) -> tuple[np.ndarray, float]:
    """Bins of the sample and the least share of them; texts that occur again count once."""
    once = {s.tobytes(): (s, lang) for s, lang in zip(sets, languages, strict=True)}.values()
    count = np.zeros(1 << BITS, np.int32)
    by_language = {lang: np.zeros(1 << BITS, np.int32) for _, lang in once}
    for s, lang in once:
        count[s] += 1
        by_language[lang][s] += 1
    own = float(np.median([(count[s] > 1).mean() for s, _ in once]))
    other = float(np.median([(count[s] > by_language[lang][s]).mean() for s, lang in once])) if len(by_language) > 1 else 0.0
    return count > 0, (own + other) / 2


def _strange(share: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Shares more than five standard errors below the bound, taken wide: at a share of one half, and each letter is in n-grams of all lengths.

    Little text is little evidence: below some 30 letters nothing is strange.
    """
    return share < least - 5 * np.sqrt(0.25 * LONGEST / size)


def fit(
    labelled: DataFrame, per_language: int = 250, landmarks: int = 40, ridge: float = 0.1
) -> Model:
    """Learn from ``text`` and ``lang``; rows where either is null, or the text has no letter, teach nothing.

    At most ``per_language`` texts of each language are used, chosen by a hash of their content, and at most
    ``landmarks`` of them are landmarks; the driver sees 32 KB a text.  Labels are taken to be a small set.  Without any labelled
    row every prediction is undetermined.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 3 * per_language / n))])
    key = F.xxhash64("text")
    chosen = (
        rows.where(F.pmod(key, F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30))
        .withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.hash("text"), key)))
        .where(F.col("_rank") <= per_language)
        .select("text", "lang", "_rank")
    )

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, bool)
        for batch in batches:
            packed = []
            for text in batch.column("text"):
                whole = np.zeros(1 << BITS, bool)
                whole[bins_of(text.as_py(), flags)] = True
                packed.append(zlib.compress(np.packbits(whole).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("_rank"), pa.array(packed, pa.binary())], ["lang", "_rank", "bits"])

    found = sorted(chosen.mapInArrow(present, "lang string, _rank int, bits binary").collect(), key=lambda r: (r.lang, r._rank))
    sets = [np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(r.bits), np.uint8))).astype(np.int32) for r in found]
    rows_in = [(s, r.lang, r._rank) for s, r in zip(sets, found, strict=True) if len(s)]
    languages = sorted({lang for _, lang, _ in rows_in})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))
    marks = [s for s, _, rank in rows_in if rank <= landmarks]
    used = np.unique(np.concatenate(marks))
    column = np.full(1 << BITS, -1, np.int64)
    column[used] = np.arange(len(used))
    matrix = np.zeros((len(used), len(marks)), np.float32)  # bins x landmarks, each landmark scaled to length 1
    for i, s in enumerate(marks):
        matrix[column[s], i] = len(s) ** -0.5
    kernel = np.empty((len(rows_in), len(marks)))
    for at in range(0, len(rows_in), 64):
        part = rows_in[at : at + 64]
        batch = np.zeros((len(part), len(used)), np.float32)
        for i, (s, _, _) in enumerate(part):
            here = column[s]
            batch[i, here[here >= 0]] = len(s) ** -0.5
        kernel[at : at + 64] = batch @ matrix
    own = np.asarray([i for i, (_, _, rank) in enumerate(rows_in) if rank <= landmarks])
    values, vectors = np.linalg.eigh(kernel[own])
    keep = values > values.max() * 1e-6
    nystroem = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ nystroem
    target = np.asarray([[float(lang == x) for x in languages] for _, lang, _ in rows_in])
    centre, level = features.mean(0), target.mean(0)
    centred = features - centre
    beta = np.linalg.solve(centred.T @ centred + ridge * np.eye(centred.shape[1]), centred.T @ (target - level))
    weights = np.zeros((1 << BITS, len(languages)), np.float32)
    weights[used] = matrix @ (nystroem @ beta).astype(np.float32)
    return Model(languages, weights, (level - centre @ beta).astype(np.float32), *_known([s for s, _, _ in rows_in], [lang for _, lang, _ in rows_in]))


def predicted(docs: DataFrame, model: Model, reject: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (the regression value of that language, within 0 to 1).

    Null text, and text without a letter, is ``und`` with score 0; so is everything under a model without languages and, with ``reject``,
    a text whose n-grams are too strange to the sample for any of its languages.
    Columns of these two names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    # other columns travel in one struct: any name will do
    others = [c for c in docs.columns if c != "text"]
    docs, names = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("others"), "text"), docs.columns
    shared = spark.sparkContext.broadcast((model.languages, model.weights, model.bias, model.known if reject else None, model.least))  # 2 ** BITS x languages: does not grow with the data
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights, bias, known, least = shared.value
        flags = np.zeros(1 << BITS, bool)
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = [bins_of(t.as_py() or "", flags) for t in block.column("text")]
                size = np.asarray([len(s) for s in sets], np.int64)
                names, score = np.full(len(sets), UNDETERMINED, object), np.zeros(len(sets))
                some = np.flatnonzero(size)
                if len(some) and languages:
                    starts = np.cumsum(size[some]) - size[some]
                    product = np.add.reduceat(weights[np.concatenate([sets[i] for i in some])], starts, axis=0)
                    values = product / np.sqrt(size[some])[:, None] + bias
                    best = values.argmax(axis=1)
                    names[some] = np.asarray(languages, object)[best]
                    score[some] = np.clip(values[np.arange(len(some)), best], 0, 1)
                    if known is not None:
                        share = np.add.reduceat(known[np.concatenate([sets[i] for i in some])], starts, dtype=np.int64) / size[some]
                        strange = some[_strange(share, size[some], least)]
                        names[strange], score[strange] = UNDETERMINED, 0
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(names, pa.string()), pa.array(score)], [*block.schema.names, "lang_pred", "score"])

    place = {c: f"others.c{i}" for i, c in enumerate(others)}
    found = docs.mapInArrow(run, schema)
    return found.select(*[F.col(place.get(c, "text")).alias(c) for c in names], "lang_pred", "score")
