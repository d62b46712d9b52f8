"""Hard negatives by an STR-packed R-tree: rows of another label whose inner product with an anchor lies in a window below a positive's.

Vectors are integers, scores exact integer inner products.  Rows are dealt into tiles by sort-tile-recursive cuts, tiles into
shards of bounded size, and each shard is an R-tree packed bottom up: rows sorted by tiles of one coordinate after the other, every
run of rows a leaf, every run of nodes a node.  A node has the minimum bounding box of its rows and the interval of their labels.
A query meets a box with one interval per coordinate, ``[min(q * low, q * high), max(q * low, q * high)]``; their sums bound every score in the
box.  The search is best first by the upper bound and leaves out boxes outside all its score windows, boxes strictly below the k-th
score of a window, and boxes whose labels do not serve.

Queries travel to shards, in blocks: first each to its own shard, which gives a k-th score to begin with, then to the shards whose own boxes
may hold something better.  A shard's tree is built once per task that holds the shard.  Nothing is sent per pair of rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklume.llm.whitening import integer_vector
from tracklume.sources.tables import stored

SHARD_ROWS, LEAF_ROWS, FANOUT, BLOCK_ROWS, BOXES = 16_384, 256, 8, 256, 512
#: rows that the cuts of the tiles are taken from, and most slices per coordinate
SAMPLE_ROWS, SLICES = 16_384, 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` in integers; by floating point where every partial sum is an exact integer."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    if any(abs(x) > MOST for x in exact.ravel()):
        raise OverflowError("a score does not fit in a long")
    return exact.astype(np.int64)


def _tiled(vectors: np.ndarray, rows: np.ndarray, along: Sequence[int], leaf: int) -> list[np.ndarray]:
    """Sort-tile-recursive order: slices of equal size along the first coordinate, each sliced along the next, down to leaves."""
    leaves = -(-len(rows) // leaf)
    if leaves <= 1:
        return [rows]
    rows = rows[np.argsort(vectors[rows, along[0]], kind="stable")]
    if len(along) == 1:
        return [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
    slices = int(np.ceil(leaves ** (1 / len(along))))
    size = -(-leaves // slices) * leaf
    return [part for i in range(0, len(rows), size) for part in _tiled(vectors, rows[i : i + size], along[1:], leaf)]


class Tree:
    """R-tree over integer vectors and labels; nodes are stored level by level, the root last."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, leaf: int = 0):
        leaf = leaf or LEAF_ROWS
        self.vectors, self.labels = vectors, labels
        spread = vectors.astype(np.float64).std(0) if len(vectors) else np.zeros(0)
        along = np.argsort(-spread, kind="stable")[:3]
        runs = []  # a leaf has rows of one label
        for label in np.unique(labels):
            runs += _tiled(vectors, np.flatnonzero(labels == label), along, leaf) if len(along) else [np.flatnonzero(labels == label)]
        self.rows = runs
        # rows of a leaf lie together, as doubles for products that are exact in them
        self.order = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        ends = np.cumsum([len(r) for r in runs])
        self.span = [(int(e) - len(r), int(e)) for r, e in zip(runs, ends, strict=True)]
        self.doubles = vectors[self.order].astype(np.float64)
        self.largest = float(np.abs(self.doubles).max(initial=0))
        self.children: list[tuple[int, int] | None] = [None] * len(runs)
        low = [vectors[r].min(0) for r in runs]
        high = [vectors[r].max(0) for r in runs]
        least, most = [int(labels[r[0]]) for r in runs], [int(labels[r[0]]) for r in runs]
        at, to = 0, len(runs)
        while to - at > 1:
            for i in range(at, to, FANOUT):
                j = min(i + FANOUT, to)
                low.append(np.min(low[i:j], axis=0))
                high.append(np.max(high[i:j], axis=0))
                least.append(min(least[i:j]))
                most.append(max(most[i:j]))
                self.children.append((i, j))
            at, to = to, len(low)
        self.low, self.high = np.asarray(low, np.float64), np.asarray(high, np.float64)
        self.least, self.most = np.asarray(least), np.asarray(most)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each query (rows) in each box (columns): sums of the coordinates' intervals, never too narrow."""
    q = queries.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    top = up @ high.T + down @ low.T
    bottom = up @ low.T + down @ high.T
    slack = 0.0
    if max(np.abs(top).max(initial=0), np.abs(bottom).max(initial=0)) >= 2.0**50:
        slack = (np.abs(up) @ np.maximum(np.abs(high), np.abs(low)).T + np.abs(down) @ np.maximum(np.abs(high), np.abs(low)).T) * 1e-9
    return bottom - slack, top + slack


def _serves(label: np.ndarray, least: np.ndarray, most: np.ndarray, same: bool) -> np.ndarray:
    """Whether a box with labels in ``[least, most]`` (columns) may hold a row of the query's label (rows), or of another."""
    inside = (least[None] <= label[:, None]) & (label[:, None] <= most[None])
    return inside if same else ~(inside & (least == most)[None])


def _alive(bottom: np.ndarray, top: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Whether a box meets any window of a query: queries x boxes against queries x windows."""
    out = np.zeros(top.shape, bool)
    for j in range(lows.shape[1]):
        out |= (top >= lows[:, j : j + 1].astype(np.float64) * (1 - 1e-15 * np.sign(lows[:, j : j + 1]))) & (bottom <= highs[:, j : j + 1].astype(np.float64) * (1 + 1e-15 * np.sign(highs[:, j : j + 1]))) & (lows[:, j : j + 1] <= highs[:, j : j + 1])
    return out


def _leaf_scores(tree: Tree, leaf: int, query: np.ndarray, exact: bool) -> np.ndarray:
    if not exact:
        return _products(query[None], tree.vectors[tree.rows[leaf]])[0]
    at, to = tree.span[leaf]
    return np.rint(tree.doubles[at:to] @ query).astype(np.int64)


def search(tree: Tree, ids: np.ndarray, own: np.ndarray, label: np.ndarray, queries: np.ndarray, lows: np.ndarray, highs: np.ndarray, same: bool, k: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Per query and window the best ``k`` rows as (score, -id) within the window, best first; rows with the query's own id do not count."""
    if not len(tree.rows):
        return
    bottom, top = bounds(queries, tree.low, tree.high)
    usable = _serves(label, tree.least, tree.most, same) & _alive(bottom, top, lows, highs)
    root = len(tree.children) - 1
    ids = ids[tree.order]
    exact = tree.largest * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < 2.0**53
    asked = queries.astype(np.float64) if exact else queries
    for i in range(len(queries)):
        windows = [j for j in range(lows.shape[1]) if lows[i, j] <= highs[i, j]]
        best: list[list[tuple[int, int]]] = [[] for _ in range(lows.shape[1])]  # heaps, the worst on top
        least = [int(x) for x in lows[i]]  # scores strictly below are of no use
        use, up, down = usable[i], top[i], bottom[i]
        heap = [(-up[root], root)] if use[root] else []
        while heap:
            bound, node = heapq.heappop(heap)
            floor = min((least[j] for j in windows if down[node] <= highs[i, j]), default=None)
            if floor is None or -bound < floor:
                if windows and -bound < min(least[j] for j in windows):
                    break  # and so is every box behind it
                continue
            if tree.children[node]:
                a, b = tree.children[node]
                for child in range(a, b):
                    if use[child]:
                        heapq.heappush(heap, (-up[child], child))
                continue
            if (int(tree.least[node]) == int(label[i])) != same:  # all rows of a leaf have one label
                continue
            a, b = tree.span[node]
            scores, keys = _leaf_scores(tree, node, asked[i], exact), ids[a:b]
            most = int(scores.max())
            for j in windows:
                if most < least[j]:
                    continue
                take = np.flatnonzero((scores >= least[j]) & (scores <= highs[i, j]) & (keys != own[i]))
                if len(take) > k:  # the k-th of them by score, with its ties
                    bar = np.partition(scores[take], len(take) - k)[len(take) - k]
                    take = take[scores[take] >= bar]
                for score, key in zip(scores[take].tolist(), (-keys[take]).tolist(), strict=True):
                    if len(best[j]) < k:
                        heapq.heappush(best[j], (score, key))
                    elif (score, key) > best[j][0]:
                        heapq.heapreplace(best[j], (score, key))
                if len(best[j]) == k:
                    least[j] = max(least[j], best[j][0][0])
        for j in windows:
            yield i, j, sorted(best[j], reverse=True)


def _tile(rows: DataFrame) -> DataFrame:
    """``rows`` with ``d`` and ``tile``: slices along the coordinate of largest spread, each cut again along the next.

    The cuts come from a bounded sample by hash; they decide where a row lies, not what is found.
    """
    sized = rows.withColumn("d", F.size("x"))
    n = sized.count()
    slices = min(SLICES, max(1, math.ceil((n / SHARD_ROWS) ** 0.5)))  # a tile has about the rows of a shard
    key = F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 20))
    sample = sized.where(key < max(1, min(1 << 20, SAMPLE_ROWS * (1 << 20) // max(n, 1)))).select("d", "x")

    def cuts(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        x = np.asarray(table.column("x").to_pylist(), np.int64).reshape(table.num_rows, d)
        along = np.argsort(-x.astype(np.float64).std(0), kind="stable")[:2].tolist() if d else []
        first, second = [], []
        if len(along) == 2:
            x = x[np.argsort(x[:, along[0]], kind="stable")]
            first = [int(s[0, along[0]]) for s in np.array_split(x, slices)[1:] if len(s)]
            bins = np.searchsorted(first, x[:, along[0]], side="right")
            for b in range(slices):
                inner = np.sort(x[bins == b, along[1]])
                second.append([int(s[0]) for s in np.array_split(inner, slices)[1:] if len(s)])
        row = {"d": [d], "along": [along], "first": [first], "second": [second]}
        types = [("d", pa.int32()), ("along", pa.list_(pa.int32())), ("first", pa.list_(pa.int64())), ("second", pa.list_(pa.list_(pa.int64())))]
        return pa.Table.from_pydict(row, schema=pa.schema(types))

    found = stored(sample.groupBy("d").applyInArrow(cuts, "d int, along array<int>, first array<long>, second array<array<long>>"), "cuts")

    def place(edges: Column, value: Column) -> Column:
        return F.size(F.filter(edges, lambda e: e <= value))

    def coordinate(i: int) -> Column:
        return F.get("x", F.get("along", F.lit(i)))

    placed = sized.join(found, "d", "left")  # a row per vector length; lengths outside the sample are one tile
    slice_ = place(F.col("first"), coordinate(0))
    tile = slice_ * slices + place(F.get("second", slice_), coordinate(1))
    return placed.withColumn("tile", F.when(F.size("along") == 2, F.coalesce(tile, F.lit(0))).otherwise(0)).drop("along", "first", "second")


_PACKED = "d int, tile int, part int, ids binary, labels binary, cells binary, low array<double>, high array<double>, least long, most long"


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by("vec_id")
    d = table.column("d")[0].as_py()
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, d)
    labels = table.column("label").to_numpy().astype(np.int64)
    row = {
        "d": [d], "tile": [table.column("tile")[0].as_py()], "part": [table.column("part")[0].as_py()], "ids": [table.column("vec_id").to_numpy().astype(np.int64).tobytes()],
        "labels": [labels.tobytes()], "cells": [x.tobytes()], "low": [x.min(0).astype(float).tolist()], "high": [x.max(0).astype(float).tolist()], "least": [int(labels.min())], "most": [int(labels.max())],
    }
    binary, long, doubles = pa.binary(), pa.int64(), pa.list_(pa.float64())
    types = [("d", pa.int32()), ("tile", pa.int32()), ("part", pa.int32()), ("ids", binary), ("labels", binary), ("cells", binary), ("low", doubles), ("high", doubles), ("least", long), ("most", long)]
    return pa.Table.from_pydict(row, schema=pa.schema(types))


_ASKED = "d int, tile int, part int, ids binary, labels binary, cells binary, lows binary, highs binary, windows int"
_ASKED_TYPES = pa.schema([("d", pa.int32()), ("tile", pa.int32()), ("part", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "cells", "lows", "highs")], ("windows", pa.int32())])


def _asked_blocks(asked: DataFrame) -> DataFrame:
    """Queries ``d, tile, part, vec_id, label, x, lows, highs`` as blocks of at most ``BLOCK_ROWS`` of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("d", "tile", "part")], axis=1)
            change = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for at, to in zip([0, *change.tolist()], [*change.tolist(), len(keys)], strict=True):
                for i in range(at, to, BLOCK_ROWS):
                    part = batch.slice(i, min(BLOCK_ROWS, to - i))
                    if part.num_rows:
                        yield _asked_row(*keys[at].tolist(), part)

    ordered = asked.repartition("d", "tile", "part").sortWithinPartitions("d", "tile", "part")
    return ordered.select("d", "tile", "part", "vec_id", "label", "x", "lows", "highs").mapInArrow(run, _ASKED)


def _asked_row(d: int, tile: int, part: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    def numbers(name: str) -> bytes:
        column = rows.column(name)
        column = column.flatten() if pa.types.is_list(column.type) else column
        return column.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()

    values = [[d], [tile], [part], *[[numbers(c)] for c in ("vec_id", "label", "x", "lows", "highs")], [len(rows.column("lows")[0])]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _ASKED_TYPES, strict=True)], schema=_ASKED_TYPES)


def _numbers(row: dict) -> tuple[np.ndarray, ...]:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    cells = np.frombuffer(row["cells"], np.int64).reshape(len(ids), row["d"])
    return ids, labels, cells


def _windows(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row[c], np.int64).reshape(-1, row["windows"]) for c in ("lows", "highs"))


def _routed(blocks: DataFrame, shards: DataFrame, same: bool) -> DataFrame:
    """Blocks of queries for every shard but their own whose box may hold something: the root level of the tree."""
    boxes = shards.select("d", "tile", "part", "low", "high", "least", "most")
    group = F.pmod(F.xxhash64("tile", "part"), F.greatest(F.lit(1), F.ceil(F.col("n") / BOXES))).cast("int")
    counts = boxes.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    grouped = boxes.join(counts, "d").withColumn("group", group).groupBy("d", "group").agg(F.collect_list(F.struct("tile", "part", "low", "high", "least", "most")).alias("boxes"))
    met = blocks.withColumnsRenamed({"tile": "own_tile", "part": "own_part"}).join(stored(grouped, "boxes"), "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, labels, cells = _numbers(row)
                lows, highs = _windows(row)
                boxes = [b for b in row["boxes"] if (b["tile"], b["part"]) != (row["own_tile"], row["own_part"])]
                if not boxes:
                    continue
                bottom, top = bounds(cells, np.asarray([b["low"] for b in boxes]), np.asarray([b["high"] for b in boxes]))
                alive = _alive(bottom, top, lows, highs) & _serves(labels, np.asarray([b["least"] for b in boxes]), np.asarray([b["most"] for b in boxes]), same)
                for b, box in enumerate(boxes):
                    some = np.flatnonzero(alive[:, b])
                    if len(some):
                        values = [[row["d"]], [box["tile"]], [box["part"]], *[[a[some].tobytes()] for a in (ids, labels, cells, lows, highs)], [row["windows"]]]
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _ASKED_TYPES, strict=True)], schema=_ASKED_TYPES)

    return met.select("d", "own_tile", "own_part", "ids", "labels", "cells", "lows", "highs", "windows", "boxes").mapInArrow(run, _ASKED)


def _searched(blocks: DataFrame, shards: DataFrame, same: bool, k: int) -> DataFrame:
    """``query_id, window, vec_id, score``: the best of each query and window in each shard it was sent to.

    A shard and the blocks sent to it lie in one task, the shard first; blocks are read one after the other.
    """
    sides = [c.strip().split(" ") for c in _ASKED.split(",")]
    trees = shards.select(*[F.col(c) if c in ("d", "tile", "part", "ids", "labels", "cells") else F.lit(None).cast(t).alias(c) for c, t in sides], F.lit(0).alias("kind"))
    both = trees.unionByName(blocks.withColumn("kind", F.lit(1)))
    tasks = max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = both.repartition(tasks, "d", "tile", "part").sortWithinPartitions("d", "tile", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, ids, held = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    key, tree, held = (row["d"], row["tile"], row["part"]), None, row
                    continue
                if key != (row["d"], row["tile"], row["part"]):
                    continue
                if tree is None:  # only a shard that is asked gets a tree
                    ids, labels, cells = _numbers(held)
                    tree = Tree(cells, labels)
                own, label, queries = _numbers(row)
                lows, highs = _windows(row)
                query, window, found, score = [], [], [], []
                for at, j, best in search(tree, ids, own, label, queries, lows, highs, same, k):
                    query += [int(own[at])] * len(best)
                    window += [j] * len(best)
                    found += [-b for _, b in best]
                    score += [a for a, _ in best]
                arrays = [pa.array(query, pa.int64()), pa.array(window, pa.int32()), pa.array(found, pa.int64()), pa.array(score, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["query_id", "window", "vec_id", "score"])

    return ordered.mapInArrow(run, "query_id long, window int, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("vec_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "window").orderBy(*order))).where(F.col("rank") <= k)


def _best(asked: DataFrame, shards: DataFrame, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of each window of each query over all shards: ``query_id, window, vec_id, score, rank``."""
    home = stored(_ranked(_searched(_asked_blocks(asked), shards, same, k), k), "home")
    kth = home.where(F.col("rank") == k).groupBy("query_id").agg(F.collect_list(F.struct("window", "score")).alias("kth"))
    # what lies below the k-th score of the own shard is of no use in another
    floors = asked.join(kth, asked.vec_id == kth.query_id, "left").drop("query_id")
    raised = F.transform("lows", lambda low, j: F.greatest(low, F.get(F.filter("kth", lambda s: s["window"] == j), F.lit(0))["score"]))
    narrowed = floors.withColumn("lows", F.when(F.col("kth").isNull(), F.col("lows")).otherwise(raised))
    others = _searched(_routed(_asked_blocks(narrowed), shards, same), shards, same, k)
    return _ranked(home.drop("rank").unionByName(others), k)


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), scale: int = 256) -> DataFrame:
    """Per anchor and positive the best rows of another label: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``vec_id``.  Rows take no part if their id, label or vector is null, or an entry is null, not finite or too large.
    The positives of an anchor are the rows of its label with the highest inner products, the negatives of a positive the highest of other labels
    between ``low`` and ``high`` (as fractions) of the positive's score; ties go to the smaller id.  A window whose ends are the wrong way round, as under
    a negative score, is empty; a positive without a negative has no row.  Rows with the anchor's own id are neither; a repeated row counts as
    often as it occurs, a repeated anchor id asks once, with its smallest label and vector.  Vectors of another length do not compare.
    An empty table gives no row.  Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integer_vector("embedding", scale).alias("x")).dropna()
    tiled = stored(_tile(stored(rows, "rows")), "tiled")
    parts = tiled.groupBy("d", "tile").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("parts"))  # at most SLICES ** 2 rows per vector length
    # dealt by a number per row, as one id may occur very often; the rows lie in files, so a repeated task deals alike
    dealt = tiled.join(parts, ["d", "tile"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "x", F.monotonically_increasing_id()), F.col("parts")).cast("int")).drop("parts")
    dealt = stored(dealt, "dealt")
    shards = stored(dealt.groupBy("d", "tile", "part").applyInArrow(_pack, _PACKED), "shards")
    anchors = dealt.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "x", "d", "tile", "part")).alias("a")).select("vec_id", "a.*")
    asked = stored(anchors, "anchors")
    everything = [F.array(F.lit(v).cast("long")).alias(c) for v, c in ((LEAST, "lows"), (MOST, "highs"))]
    nearest = stored(_best(asked.select("*", *everything), shards, True, positives), "positives")
    score = F.col("score").cast("decimal(38,0)")
    # whole scores s with low * p <= s <= high * p
    least = F.ceil(score * low[0] / low[1]).cast("long")
    most = F.floor(score * high[0] / high[1]).cast("long")
    windows = nearest.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", least.alias("low"), most.alias("high"), F.col("vec_id").alias("positive_id"), "score"))).alias("w"))
    # every query has the same number of windows: absent ones are empty
    lows = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("w", i)["low"], F.lit(1).cast("long")))
    highs = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("w", i)["high"], F.lit(0).cast("long")))
    wanted = asked.join(windows, asked.vec_id == windows.query_id).select("vec_id", "label", "x", "d", "tile", "part", lows.alias("lows"), highs.alias("highs"))
    found = _best(wanted, shards, False, negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "rank": "place"})
    named = nearest.select("query_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = found.join(named, ["query_id", "window"])
    return both.select(
        F.col("query_id").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
