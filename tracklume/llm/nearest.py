"""Exact top-k search by integer inner product with KD-trees.

Vectors become integers, ``floor(scale * x)``.  Candidates are dealt into shards of bounded size, and each shard is a KD-tree:
median splits along the dimension of largest spread, down to leaves, with the tight box of every node.  The inner product of a
query with anything in a box is at most ``sum(max(q * low, q * high))``.  A query goes best first through a shard, the
node with the highest bound next, and stops where the bound falls below its k-th score.  That score is propagated: a first
pass looks at one leaf per query and shard, and every shard then starts with the best k-th score of all of them.

Queries come in blocks, a row per block and shard; nothing is sent per pair of vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklume.sources.tables import stored

SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 16_384, 256, 512


def _matrix(ids: np.ndarray, cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.int64).reshape(len(ids), -1)


def _exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in integers; by floating point where every partial sum is an exact integer."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if any(abs(x) >= 1 << 63 for x in exact.ravel()):
        raise OverflowError("a score does not fit in a long")
    return exact.astype(np.int64)


class Tree:
    """KD-tree over integer vectors; leaves are ranges of ``order``."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(vectors))
        self.low, self.high, self.span, self.children = [], [], [], []
        self._grow(vectors, 0, len(vectors), leaf)
        self.low, self.high = np.asarray(self.low, np.float64), np.asarray(self.high, np.float64)

    def _grow(self, vectors: np.ndarray, at: int, to: int, leaf: int) -> int:
        rows = vectors[self.order[at:to]]
        low, high = rows.min(0), rows.max(0)
        node = len(self.span)
        self.low.append(low)
        self.high.append(high)
        self.span.append((at, to))
        self.children.append(None)
        if to - at > leaf and (high > low).any():
            along = int((high.astype(np.float64) - low).argmax())
            middle = (to - at) // 2
            self.order[at:to] = self.order[at:to][np.argpartition(rows[:, along], middle, kind="introselect")]
            self.children[node] = (self._grow(vectors, at, at + middle, leaf), self._grow(vectors, at + middle, to, leaf))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest score of each query (rows) in the box of each node (columns), never too small."""
        q = queries.astype(np.float64)
        best = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        return best + (1 + np.abs(best)) * 1e-9 * (np.abs(best) >= 2.0**50)


def _search(tree: Tree, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, one_leaf: bool) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Best ``k`` of each query as (score, -id), in any order; ``floor``: scores below it are of no use."""
    bounds = tree.bounds(queries)
    for i in range(len(queries)):
        bound, best = bounds[i], []  # a heap of (score, -id), the worst on top
        heap = [(-bound[0], 0)]
        least = float(floor[i])
        while heap:
            top, node = heapq.heappop(heap)
            if -top < least:
                break
            if tree.children[node]:
                for child in tree.children[node]:
                    if bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            at, to = tree.span[node]
            rows = tree.order[at:to]
            scores = _exact_product(queries[i : i + 1], vectors[rows])[0]
            use = (scores >= least) & (ids[rows] != own[i])
            for score, key in zip(scores[use].tolist(), (-ids[rows][use]).tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (score, key))
                elif (score, key) > best[0]:
                    heapq.heapreplace(best, (score, key))
            if len(best) == k:
                least = max(least, best[0][0])
            if one_leaf and len(best) == k:
                break
        yield i, best


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``n`` (dimensions), ``cells`` (64-bit integers) of the usable vectors.

    A vector that is null or holds a null or non-finite component is not usable, nor is a row with a null id.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, cells = [], [], []
            for key, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                values = vector.values
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if values.null_count or not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                if (np.abs(x) >= 2.0**62).any():
                    raise OverflowError("a component does not fit in a long")
                ids.append(key)
                n.append(len(x))
                cells.append(x.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(cells, pa.binary())], ["vec_id", "n", "cells"])

    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, n int, cells binary")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` highest scores of each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties to the smaller ``vec_id``.

    ``is_query`` is a condition on ``vec_id``.  Candidates are all rows but those with the query's own id; vectors of another length than the
    query's are no candidates.  With fewer candidates than ``k`` all are returned.  An empty table gives no row; a repeated
    ``vec_id`` is a candidate as often as it occurs, and as a query it is answered once.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    whole = stored(integers(vectors, scale), "vectors")
    sizes = whole.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(is_query, 1).otherwise(0)).alias("asked"))
    per_size = sizes.select("n", F.ceil(F.col("rows") / SHARD_ROWS).cast("int").alias("shards"), F.ceil(F.col("asked") / BLOCK_ROWS).cast("int").alias("blocks"))
    sized = whole.join(F.broadcast(per_size), "n")  # a row per vector length

    packed = "n int, shard int, ids binary, cells binary"

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids = table.column("vec_id").to_numpy().astype(np.int64).tobytes()
        row = {"n": [table.column("n")[0].as_py()], "shard": [table.column("shard")[0].as_py()], "ids": [ids], "cells": [b"".join(table.column("cells").to_pylist())]}
        return pa.Table.from_pydict(row, schema=pa.schema([("n", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary())]))

    columns = ["n", "shard", "vec_id", "cells"]
    row_hash = F.xxhash64("vec_id", "cells")
    shards = stored(sized.withColumn("shard", F.pmod(row_hash, F.col("shards")).cast("int")).select(columns).groupBy("n", "shard").applyInArrow(pack, packed), "shards")
    asked = sized.where(is_query).dropDuplicates(["vec_id"]).withColumn("shard", F.pmod(row_hash, F.greatest(F.col("blocks"), F.lit(1))).cast("int"))
    blocks = asked.select(columns).groupBy("n", "shard").applyInArrow(pack, packed).select("n", F.col("shard").alias("block"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"))
    blocks = stored(blocks, "queries")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = blocks.join(F.broadcast(per_size), "n").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))

    def searched(one_leaf: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                    matrix = np.frombuffer(row["cells"], np.int64).reshape(len(ids), row["n"])
                    queries = np.frombuffer(row["q_cells"], np.int64).reshape(len(own), row["n"])
                    floor = np.full(len(own), -np.inf)
                    if row["floors"]:
                        known = {f["query_id"]: f["floor"] for f in row["floors"]}
                        floor = np.asarray([known.get(i, -np.inf) for i in own.tolist()], np.float64)
                    found = list(_search(Tree(matrix), ids, matrix, own, queries, floor, k, one_leaf))
                    query, key, score = [], [], []
                    for i, best in found:
                        query += [int(own[i])] * len(best)
                        key += [-b for _, b in best]
                        score += [a for a, _ in best]
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(key, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

        return run

    result = "query_id long, vec_id long, score long"
    pairs = met.join(shards, ["n", "shard"])
    none = F.lit(None).cast("array<struct<query_id:long,floor:double>>")
    order = [F.col("score").desc(), F.col("vec_id")]
    fields = ["n", "ids", "cells", "q_ids", "q_cells", "floors"]
    first = pairs.withColumn("floors", none).select(fields).repartition(tasks).mapInArrow(searched(True), result)
    best = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") == k)
    # the next lower double is below the k-th score also where a long is no double
    floors = stored(best.select("query_id", (F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15).alias("floor")), "floors")
    by_block = asked.join(floors, asked.vec_id == floors.query_id).groupBy("n", F.col("shard").alias("block")).agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))
    second = pairs.join(by_block, ["n", "block"], "left").select(fields).repartition(tasks).mapInArrow(searched(False), result)
    ranked = second.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
