"""Order MinHash fingerprints of whole texts.

Every k-mer of a text (``k`` consecutive code points) is numbered by how often it occurred before, so that repeats count.  For
each of ``entries`` hash functions, the ``tuple_size`` numbered k-mers with the smallest values are selected, put back into
the order in which they stand in the text, and hashed together.  Two texts agree in an entry if the same k-mers were selected
*and* stand in the same order, so the share of equal entries falls with the edit distance, also under moves that a plain
MinHash does not see.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.llm.text import mix

K, TUPLE, ENTRIES = 8, 2, 64
_BUFFER = np.empty(1 << 17, np.uint32)  # k-mers x functions that are looked at together
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FUNCTIONS: dict[int, np.ndarray] = {}


def _factors(entries: int) -> np.ndarray:
    if entries not in _FUNCTIONS:
        _FUNCTIONS[entries] = (mix(np.arange(1, entries + 1, dtype=np.uint64) * _STEP) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return _FUNCTIONS[entries]


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmers_of(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of every k-mer, by doubling; a text shorter than ``k`` is one k-mer, the empty text has none."""
    k = min(k, len(points))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(points) - k + 1
    power = points * _STEP + np.uint64(1)  # windows of ``size`` code points
    out, covered, size, factor = None, 0, 1, int(_STEP)
    while True:
        if k & size:
            out = power[:n].copy() if out is None else out * np.uint64(factor) + power[covered : covered + n]
            covered += size
        if 2 * size > k:
            break
        power = power[:-size] * np.uint64(factor) + power[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    out += np.uint64(k)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(29)
    return out


def sketch(kmers: np.ndarray, tuple_size: int = TUPLE, entries: int = ENTRIES) -> np.ndarray:
    """Signature of a text given by the hashes of its k-mers: ``entries`` 32-bit values; all zero for the empty text.

    A text with fewer k-mers than ``tuple_size`` selects all it has.
    """
    n = len(kmers)
    if not n:
        return np.zeros(entries, np.uint32)
    # number equal k-mers in text order: sort (hash, place) packed in one word
    bits = np.uint64(max(1, int(n).bit_length()))
    packed = kmers >> bits
    packed <<= bits
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    same = (packed[1:] ^ packed[:-1]) >> bits == 0
    again = np.flatnonzero(same) + 1
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    if len(again):
        first = np.flatnonzero(np.diff(again, prepend=-1) != 1)  # of each run of repeats
        count = np.arange(1, len(again) + 1) - np.repeat(first, np.diff(np.append(first, len(again))))
        place = (packed[again] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        short[place] = (mix(kmers[place] + count.astype(np.uint64) * _STEP) >> np.uint64(32)).astype(np.uint32)
    factors = _factors(entries)
    take = min(tuple_size, n)
    chosen = np.empty((entries, take), np.int64)
    rows = max(1, min(entries, len(_BUFFER) // n))
    buffer = _BUFFER if rows * n <= len(_BUFFER) else np.empty(n, np.uint32)
    for at in range(0, entries, rows):
        some = factors[at : at + rows, None]
        grid = np.multiply(some, short[None, :], out=buffer[: len(some) * n].reshape(len(some), n))
        line = np.arange(len(grid))
        for i in range(take):
            best = grid.argmin(axis=1)
            chosen[at : at + rows, i] = best
            if i + 1 < take:
                grid[line, best] = np.iinfo(np.uint32).max
    chosen.sort(axis=1)
    out = np.full(entries, take, np.uint64)
    for i in range(take):
        out = mix(out * _STEP + kmers[chosen[:, i]])
    return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def edited_kmers(points: np.ndarray, kmers: np.ndarray, following: np.ndarray, following_kmers: np.ndarray, k: int) -> np.ndarray:
    """K-mers of the edited text; those inside either part are taken over, only those across the border are new."""
    half = len(points) // 2
    keep, new = len(points) - half, min(half, len(following))
    if keep < k or new < k:
        return kmers_of(np.concatenate([points[:keep], following[:new]]), k)
    across = kmers_of(np.concatenate([points[keep - k + 1 : keep], following[: k - 1]]), k) if k > 1 else kmers[:0]
    return np.concatenate([kmers[: keep - k + 1], across, following_kmers[: new - k + 1]])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries, 0 to 1."""
    return float((a == b).mean())


def written(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def in_descending_parts(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of ``doc_id``, ``text`` in ranges of ``doc_id``, each sorted descending, with the row that follows the range.

    The row after a range is the first of the next range (after the last: the first of all), marked by ``_copy``.  A range has one
    such row, so besides one shuffle of the texts only a text per partition is copied.  Null ids come last; rows with one id are
    ordered by their text.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_key", F.coalesce("doc_id", F.lit(lowest)))
    steps = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("_key", steps, 20 * parts).alias("at")).first().at if steps else []
    inner = sorted({float(x) for x in found or []})
    splits = [-float("inf"), *inner, float("inf")]
    if inner:
        ranged = Bucketizer(splits=splits, inputCol="_double", outputCol="_bucket").transform(docs.withColumn("_double", F.col("_key").cast("double")))
        ranged = ranged.withColumn("_part", F.col("_bucket").cast("int")).drop("_bucket", "_double")
    else:
        ranged = docs.withColumn("_part", F.lit(0))
    tops = sorted((r._part, r.top) for r in ranged.groupBy("_part").agg(F.max("_key").alias("top")).collect())  # a row per range
    follow = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    borders = spark.createDataFrame(follow, "_key long, _to int")
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_to").alias("part"), F.lit(True).alias("copy"))
    spread = (
        ranged.join(F.broadcast(borders), "_key", "left")
        .withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
        .select("doc_id", "text", "_key", F.col("_at.part").alias("_part"), F.col("_at.copy").alias("_copy"))
    )
    return spread.repartitionById(parts, F.col("_part")).sortWithinPartitions("_copy", F.col("_key").desc(), "text")


def fingerprints(docs: DataFrame, k: int = K, tuple_size: int = TUPLE, entries: int = ENTRIES, parts: int | None = None) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness.

    The edited text has the last half (rounded down) of the code points replaced by the first as many of the next document in descending
    ``doc_id``; the last document is followed by the first.  Null text is empty; a table of one row follows itself; an empty table gives no row;
    other columns are not read.
    """
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        out: list[list] = [[] for _ in names]
        before = None

        def finish(next_text: str, next_points: np.ndarray, next_kmers: np.ndarray, next_sketch: np.ndarray) -> None:
            doc_id, text, points, kmers, own = before
            half = len(points) // 2
            edited = text[: len(points) - half] + next_text[:half]
            other = sketch(edited_kmers(points, kmers, next_points, next_kmers, k), tuple_size, entries)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            row = (doc_id, len(points), digest, written(own), written(other), likeness(own, other), likeness(own, next_sketch))
            for column, value in zip(out, row, strict=True):
                column.append(value)

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
            for column in out:
                column.clear()
            return batch

        ended = False
        for batch in batches:
            for doc_id, text, copy in zip(batch.column("doc_id"), batch.column("text"), batch.column("_copy"), strict=True):
                if ended:
                    break
                text = text.as_py() or ""
                points = points_of(text)
                kmers = kmers_of(points, k)
                own = sketch(kmers, tuple_size, entries)
                if before is not None:
                    finish(text, points, kmers, own)
                if copy.as_py():
                    ended = True
                else:
                    before = (doc_id.as_py(), text, points, kmers, own)
                if len(out[0]) >= 1000:
                    yield flush()
        if out[0]:
            yield flush()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_descending_parts(docs, parts).select("doc_id", "text", "_copy").mapInArrow(run, schema)
