"""Quality of a text by naive Bayes support vectors.

A text is the set of its n-grams: 1 to 4 bytes as they are, and single words and word pairs in lower case, hashed into ``2 ** BITS`` bins.  With ``p`` and
``q`` the bins' counts (plus one) over the good and the poor texts of the sample, ``r = log((p / |p|) / (q / |q|))``.  Each indicator is scaled by
its ``r``, the row brought to length one, and a linear hinge-loss model fitted by dual coordinate descent.  A logistic curve fitted on the part of the
sample that the model did not see turns margins into probabilities, with each class weighted as it occurs among all labelled rows.

Scoring reads each text once where it lies: two table look-ups per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklume.llm.text import LOWER_VALUES, WHITE, blocks, flat, mix, span_hashes, word_bounds
from tracklume.sources.tables import stored

BITS = 18
LONGEST = 4
#: most n-grams of all sample texts together that one fit holds; texts beyond it, in the order of their hash, do not teach
MOST_FEATURES = 40_000_000

_SHIFT = np.uint64(64 - BITS)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _bins(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct bins of each text of a column; null and empty texts have none."""
    data, offsets = flat(column)
    grams, packed = [], np.zeros(len(data), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(data) < n:
            break
        packed = packed[: len(data) - n + 1] * np.uint64(256) + data[n - 1 :]
        mixed = (packed + np.uint64(n << 40)) * _STEP
        grams.append(((mixed ^ (mixed >> np.uint64(32))) * _STEP >> _SHIFT).astype(np.int32))
    starts, _, before = word_bounds(data, offsets, WHITE)
    words = span_hashes(data, starts, LOWER_VALUES) if len(starts) else np.zeros(0, np.uint64)
    pairs = mix(words[:-1] * _STEP + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)
    words, pairs = (words >> _SHIFT).astype(np.int32), (pairs >> _SHIFT).astype(np.int32)
    flags = np.zeros(1 << BITS, bool)
    for i in range(len(column)):
        a, b = offsets[i], offsets[i + 1]
        if a == b:
            yield np.zeros(0, np.int32)
            continue
        for n, gram in enumerate(grams, 1):
            flags[gram[a : max(a, b - n + 1)]] = True
        a, b = before[i], before[i + 1]
        flags[words[a:b]] = True
        flags[pairs[a : max(a, b - 1)]] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        yield found.astype(np.int32)


@dataclass(frozen=True)
class Model:
    scaled: np.ndarray | None = None  # r * weight by bin
    squares: np.ndarray | None = None  # r * r by bin
    bias: float = 0.0
    slope: float = 1.0
    level: float = 0.0

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(sets), self.bias)
        if self.scaled is None:
            return out
        for i, s in enumerate(sets):
            length = float(self.squares[s].sum(dtype=np.float64))
            if length > 0:
                out[i] += float(self.scaled[s].sum(dtype=np.float64)) / length**0.5
        return out

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(sets) + self.level, -700, 700)))


def log_count_ratios(sets: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = [np.ones(1 << BITS), np.ones(1 << BITS)]
    for s, y in zip(sets, good.tolist(), strict=True):
        counts[int(y)][s] += 1
    poor, fine = counts
    return np.log((fine / fine.sum()) / (poor / poor.sum()))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, size: int, cost: float = 1.0, epochs: int = 30, gap: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and dual variables of ``min |w|^2 / 2 + sum c_i max(0, 1 - y_i w x_i)`` over sparse rows (places, values).

    The last place of ``size`` is the constant.  One dual variable at a time is set to its best value within ``[0, c_i]``, in a new random order each
    epoch, until no projected gradient spreads by more than ``gap``.  Both classes have the same total cost.
    """
    y = np.where(good, 1.0, -1.0)
    share = np.where(good, good.mean(), 1 - good.mean())
    upper = cost * 0.5 / share
    w, alpha = np.zeros(size), np.zeros(len(rows))
    diagonal = np.asarray([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        highest, lowest = -np.inf, np.inf
        for i in rng.permutation(len(rows)).tolist():
            at, values = rows[i]
            gradient = y[i] * float(w[at] @ values) - 1
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == upper[i] else gradient
            highest, lowest = max(highest, projected), min(lowest, projected)
            if projected:
                new = min(max(alpha[i] - gradient / diagonal[i], 0.0), upper[i])
                w[at] += (new - alpha[i]) * y[i] * values
                alpha[i] = new
        if highest - lowest <= gap:
            break
    return w, alpha


def _curve(margins: np.ndarray, good: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and level of the logistic curve with the highest weighted likelihood, targets drawn in by one row each."""
    n = np.asarray([(~good).sum(), good.sum()])
    target = np.where(good, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    beta = np.asarray([1.0, 0.0])

    def loss(b):
        z = x @ b
        return float(weights @ (np.logaddexp(0, z) - target * z)) + 1e-6 * float(b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -700, 700)))
        gradient = x.T @ (weights * (p - target)) + 2e-6 * beta
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-8 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


def trained(sets: list[np.ndarray], good: np.ndarray, totals: tuple[int, int], cost: float = 1.0) -> Model:
    """Model of sample texts; every fifth one is kept for the curve.  ``totals``: all labelled rows that are poor and good."""
    prior = (totals[1] + 1) / (sum(totals) + 2)
    plain = Model(level=float(np.log(prior / (1 - prior))), slope=0.0)
    apart = np.arange(len(sets)) % 5 == 4
    if not all((good[part] == side).any() for part in (apart, ~apart) for side in (True, False)):
        return plain  # too little to learn from: the share of good rows
    learn, hold = np.flatnonzero(~apart), np.flatnonzero(apart)
    r = log_count_ratios([sets[i] for i in learn], good[learn])
    rows = []
    for i in learn:
        values = r[sets[i]]
        length = float(np.sqrt(values @ values)) or 1.0
        rows.append((np.append(sets[i], 1 << BITS), np.append(values / length, 1.0)))
    w, _ = dual_coordinate_descent(rows, good[learn], (1 << BITS) + 1, cost)
    model = Model((r * w[:-1]).astype(np.float32), (r * r).astype(np.float32), float(w[-1]))
    n = [(~good[hold]).sum(), good[hold].sum()]
    weights = np.where(good[hold], prior / n[1], (1 - prior) / n[0])
    slope, level = _curve(model.margins([sets[i] for i in hold]), good[hold], weights * len(hold))
    return Model(model.scaled, model.squares, model.bias, slope, level)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Model:
    """Learn from ``text`` of ``docs`` and ``quality`` (0 or 1) of ``labels``, by ``doc_id``.

    An id with several labels has the more frequent one, none at a tie; a repeated id in ``docs`` teaches once, with its least text; null ids, other labels
    and null texts teach nothing.  At most ``per_class`` ids of each class are used, chosen by a hash of the id, and at most ``MOST_FEATURES``
    n-grams; class shares come from all labelled ids.  One task holds the sample, the driver only the model.  Without texts of both classes the model is the share
    of good rows (a half without labels).
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.avg("quality").alias("_share"))
    known = known.where("_share <> 0.5").select("_id", (F.col("_share") > 0.5).alias("_good"))
    held = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    ids = held.select("doc_id").join(known, F.col("doc_id") == F.col("_id"), "left_semi").distinct()  # labelled ids of these documents; no text moves
    there = stored(known.join(ids, F.col("_id") == F.col("doc_id"), "left_semi"), "labelled")
    totals = {r["_good"]: r.n for r in there.groupBy("_good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return trained([], np.zeros(0, bool), (0, 0))
    key = F.xxhash64("_id")
    # only ids that may be among the first of their class are ranked; by their hash, so three times as many are enough
    rate = F.create_map(*[F.lit(x) for good, n in totals.items() for x in (good, min(1.0, 3 * per_class / n))])
    likely = there.where(F.pmod(key, F.lit(1 << 30)) < F.element_at(rate, F.col("_good")) * (1 << 30))
    chosen = likely.withColumn("_rank", F.row_number().over(Window.partitionBy("_good").orderBy(F.pmod(key, F.lit(1 << 30)), key, "_id"))).where(F.col("_rank") <= per_class)
    sample = held.join(F.broadcast(stored(chosen, "chosen")), F.col("doc_id") == F.col("_id"))  # at most 2 * per_class ids
    once = sample.groupBy("_id", "_good", "_rank").agg(F.min("text").alias("text"))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                found = [s.tobytes() for s in _bins(block.column("text"))]
                yield pa.RecordBatch.from_arrays([block.column("_good"), block.column("_rank"), pa.array(found, pa.binary())], ["good", "rank", "bins"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rank", "ascending"), ("good", "ascending")])
        sizes = np.cumsum([len(b) // 4 for b in table.column("bins").to_pylist()])
        table = table.slice(0, int(np.searchsorted(sizes, MOST_FEATURES, side="right")))
        sets = [np.frombuffer(b, np.int32) for b in table.column("bins").to_pylist()]
        model = trained(sets, np.asarray(table.column("good").to_pylist(), bool), (totals.get(False, 0), totals.get(True, 0)))
        tables = [None if a is None else a.tobytes() for a in (model.scaled, model.squares)]
        row = {"scaled": [tables[0]], "squares": [tables[1]], "bias": [model.bias], "slope": [model.slope], "level": [model.level]}
        return pa.Table.from_pydict(row, schema=pa.schema([("scaled", pa.binary()), ("squares", pa.binary()), *[(c, pa.float64()) for c in ("bias", "slope", "level")]]))

    sets = once.select("text", "_good", "_rank").mapInArrow(present, "good boolean, rank int, bins binary").withColumn("all", F.lit(0))
    fitted = sets.groupBy("all").applyInArrow(learn, "scaled binary, squares binary, bias double, slope double, level double").collect()
    row = fitted[0]
    tables = [None if b is None else np.frombuffer(bytes(b), np.float32) for b in (row.scaled, row.squares)]
    return Model(*tables, row.bias, row.slope, row.level)


def scored(docs: DataFrame, model: Model, bound: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with ``score`` (probability that the text is good) and ``predicted`` (1 from ``bound`` on, else 0).

    Only ``text`` is read; null is an empty text, which has the score of a text without n-grams.  Very long texts are read whole.  Columns of these two names
    are replaced, all others pass through whatever their names.
    """
    docs = docs.drop("score", "predicted")
    others = [c for c in docs.columns if c != "text"]
    names = docs.columns
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("others"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers: does not grow with the data
    schema = T.StructType([*packed.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                score = shared.value.scores(list(_bins(block.column("text"))))
                arrays = [*block.columns, pa.array(score), pa.array((score >= bound).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, [*block.schema.names, "score", "predicted"])

    place = {c: f"others.c{i}" for i, c in enumerate(others)}
    found = packed.mapInArrow(run, schema)
    return found.select(*[F.col(place.get(c, "text")).alias(c) for c in names], "score", "predicted")
