"""Packing token sequences into windows by multiway differencing.

Documents are cut: whole windows first, the rest into pieces of at most ``piece`` ids.  Whole windows need no partner.  The
other pieces are dealt into groups of bounded size, and each group is a number-partitioning problem: ``m`` windows whose
sums should be nearly equal.  The largest differencing method (Karmarkar and Karp) starts with one partial partition per piece,
and always merges the two with the largest imbalance, the heaviest window of one onto the lightest of the other.  If the
heaviest window is over capacity at the end, ``m`` rises and the group is divided again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.llm.text import blocks
from tracklume.llm.tokens import encoder, finished

PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, m: int) -> np.ndarray:
    """Window (0 to m - 1) of each size, by multiway differencing: sums of the windows come out nearly equal."""
    n = len(sizes)
    if m <= 1 or n == 0:
        return np.zeros(n, np.int64)
    # A partial partition: sums of its heaviest windows in ascending order (the other m - k are empty), and for each
    # the node of a merge tree; leaves 0 to n - 1 are the pieces.
    left, right = [-1] * n, [-1] * n
    order = np.argsort(-sizes, kind="stable")
    heap = [(-int(sizes[i]), int(rank), np.asarray([sizes[i]], np.int64), [int(i)]) for rank, i in enumerate(order)]
    heapq.heapify(heap)
    ticket = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heap[0]
        if len(a) + len(b) <= m:  # enough empty windows: nothing meets
            sums = np.concatenate([a, b])
            nodes = a_nodes + b_nodes
        else:
            wide = np.zeros(m, np.int64)
            wide[m - len(a) :] = a
            wide[: len(b)] += b[::-1]
            nodes = [-1] * (m - len(a)) + a_nodes
            for i, node in enumerate(reversed(b_nodes)):
                if nodes[i] < 0:
                    nodes[i] = node
                elif node >= 0:
                    left.append(nodes[i])
                    right.append(node)
                    nodes[i] = len(left) - 1
            sums = wide
        rank = np.argsort(sums, kind="stable")
        sums = sums[rank]
        nodes = [nodes[i] for i in rank]
        spread = int(sums[-1] - (sums[0] if len(sums) == m else 0))
        if len(sums) == m and sums[0]:  # only differences matter from here on
            sums = sums - sums[0]
        heapq.heapreplace(heap, (-spread, ticket, sums, nodes))
        ticket += 1
    window = np.zeros(n, np.int64)
    for w, node in enumerate(heap[0][3]):
        stack = [node] if node >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                window[x] = w
            else:
                stack += [left[x], right[x]]
    return window


def balanced(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of at most ``capacity`` for pieces no larger than that: the fewest that differencing finds, counting up."""
    m = max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        window = differencing(sizes, m)
        if np.bincount(window, weights=sizes, minlength=m).max(initial=0) <= capacity:
            return window
        m += 1


def packed(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, piece: int = 512, group_windows: int = 128
) -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most ``window`` ids.

    One row per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids`` (little-endian uint32),
    ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` in the sequence (gapless from 0).  Null text is empty: such a
    document is its end id alone.  Repeated rows are packed as often as they occur; other columns are not read; an
    empty table gives no row.

    Groups hold about ``group_windows`` windows whatever the size of the corpus; their number follows the total length.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    groups = max(1, total // (3 * window * group_windows))  # three bytes an id, roughly: sets the size of a task alone

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, turn = encoder(tokenizer), 0
        for batch in batches:
            for block in blocks(batch, "text"):
                ids, counts = encode.encode(block.column("text"))
                n = counts + 1
                ends = np.cumsum(n)
                all_ids = np.empty(int(ends[-1]), "<u4")
                last = np.zeros(len(all_ids), bool)
                last[ends - 1] = True
                all_ids[last], all_ids[~last] = end_id, ids
                whole = n // window
                rest = n - whole * window
                per_doc = whole + -(-rest // piece)
                doc = np.repeat(np.arange(len(n)), per_doc)
                i = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                full = i < whole[doc]
                # the rest is cut evenly, so that no tiny piece is left over
                k = np.maximum(per_doc - whole, 1)[doc]
                j = np.where(full, 0, i - whole[doc])
                start = np.where(full, i * window, whole[doc] * window + j * rest[doc] // k)
                stop = np.where(full, (i + 1) * window, whole[doc] * window + (j + 1) * rest[doc] // k)
                base = (ends - n)[doc]
                raw = all_ids.tobytes()
                parts = [raw[4 * a : 4 * b] for a, b in zip((base + start).tolist(), (base + stop).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(stop - start), pa.array(parts, pa.binary()), pa.array(n[doc]), pa.array(turn + np.arange(len(doc)))],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "turn"],
                )
                turn += len(doc)
        del encode
        finished()

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        # an order of its own makes the result independent of how rows arrive
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        length = table.column("length").to_numpy()
        full = length == window
        place = np.empty(len(length), np.int64)
        place[full] = np.arange(full.sum())
        place[~full] = full.sum() + balanced(length[~full], window)
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(length[order])
        first = np.concatenate([[True], place[order][1:] != place[order][:-1]]) if len(order) else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(first, ends - length[order], 0))
        offset = np.empty(len(length), np.int64)
        offset[order] = ends - length[order] - begin
        sequence = (np.int64(key[0].as_py()) << np.int64(32)) + place
        return table.select(["doc_id", "start", "length", "ids", "doc_tokens"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    pieces = docs.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, turn long")
    # turn: a document that occurs very often is dealt out like others
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "turn"), F.lit(groups))).drop("turn")
    return dealt.groupBy("_group").applyInArrow(pack, PACKED)
