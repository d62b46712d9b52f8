"""Removal of repeated passages by difference-cover anchors.

A window is ``WINDOW`` consecutive words.  With the difference cover ``COVER`` modulo ``PERIOD``, any two word positions i and j
have a shift below the period that moves both onto cover positions, so any two equal windows hold an equal
anchor (``WINDOW - PERIOD + 1`` words) that starts at a cover position in both.  Only anchors at cover positions are hashed and
compared over the corpus, 4 of 13 positions.  Where an anchor occurs again it is extended: the windows around it are
hashed in turn and compared exactly, and a window counts as repeated if its words also start earlier.

Hashes travel in packed arrays, one row per task and target.  A task first settles what repeats among its own texts
and sends one occurrence of each hash, so that a passage of very many documents reaches a target once per task.

Rows without an id are told apart by a hash of their text, and their places are negative, which puts them first.  A repeated window is
reported with its hash and removed where a row with that id has it, so that different texts under one id do not lose each other's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.llm.text import WHITE, blocks, flat, window_hashes, word_bounds, word_hashes

WINDOW = 20
#: a perfect difference set: every remainder modulo 13 is a difference of two of its members
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_SETTLED = -1  # stands for the place of an occurrence that is already reported
_NO_ID = np.iinfo(np.int32).min  # added to the places of a row without id
TEXT_BYTES, HASH_BYTES = 4 << 20, 16 << 20  # text per group of documents, and per target of hashes


def _pack(hashes: np.ndarray | None, doc: np.ndarray, place: np.ndarray) -> bytes:
    parts = [] if hashes is None else [hashes.astype(np.uint64).tobytes()]
    return b"".join([*parts, doc.astype(np.int64).tobytes(), place.astype(np.int32).tobytes()])


def _unpack(cells: bytes, hashed: bool) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    n = len(cells) // (20 if hashed else 12)
    at = 8 * n if hashed else 0
    hashes = np.frombuffer(cells, np.uint64, n) if hashed else None
    return hashes, np.frombuffer(cells, np.int64, n, at), np.frombuffer(cells, np.int32, n, at + 8 * n)


def _rows(target: np.ndarray, settled: bool, hashes: np.ndarray | None, doc: np.ndarray, place: np.ndarray) -> list[tuple[int, bool, bytes]]:
    """One row per target; inside it the given order stays, which is that of documents and compresses well."""
    order = np.argsort(target, kind="stable")
    target, doc, place = target[order], doc[order], place[order]
    hashes = hashes if hashes is None else hashes[order]
    cuts = [*np.flatnonzero(np.diff(target, prepend=-1)).tolist(), len(target)] if len(target) else [0]
    return [
        (int(target[a]), settled, _pack(None if hashes is None else hashes[a:b], doc[a:b], place[a:b]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]


def _batch(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    target, settled, cells = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), pa.array(settled, pa.bool_()), pa.array(cells, pa.binary())], ["target", "settled", "cells"])


def _target(hashes: np.ndarray, targets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(targets) >> np.uint64(32)).astype(np.int64)


def _in_order(hashes: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, then earlier starts first; which have a hash for the first time; which repeat the row before in all (rows that share an id)."""
    order = np.lexsort((place, doc, place >= 0, hashes))
    hashes, doc, place = hashes[order], doc[order], place[order]
    fresh, same = np.ones(len(order), bool), np.zeros(len(order), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    same[1:] = ~fresh[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
    return order, fresh, same


def _repeated(fresh: np.ndarray, all_but_first: bool) -> np.ndarray:
    return ~fresh if all_but_first else ~(fresh & np.append(fresh[1:], True))


def _dealt(hashes: np.ndarray, doc: np.ndarray, place: np.ndarray, targets: int, all_but_first: bool) -> list[tuple[int, bool, bytes]]:
    """What one task sends: one occurrence of each hash, and (settled) those already known to be repeated.

    With ``all_but_first`` an occurrence is repeated if an earlier one exists, else if any other one exists.  The occurrences
    of a hash that is settled as a whole are sent as such: others must see the hash, nobody needs to report it again.
    Rows that share an id and have the hash at the same place are one occurrence: neither starts earlier.
    """
    order, fresh, same = _in_order(hashes, doc, place)
    first = np.zeros(len(hashes), bool)
    first[order[fresh]] = True
    again = np.zeros(len(hashes), bool)
    again[order[~same]] = _repeated(fresh[~same], all_but_first)
    target = _target(hashes, targets)
    sent = np.where(again, _SETTLED, place)
    rows = _rows(target[first], False, hashes[first], doc[first], sent[first])
    return rows + _rows(target[again], True, hashes[again] if all_but_first else None, doc[again], place[again])


def _compared(table: pa.Table, groups: int, all_but_first: bool) -> list[tuple[int, bool, bytes]]:
    """Repeated occurrences among the rows of one target, packed by group of documents."""
    open_rows = [_unpack(c.as_py(), True) for c, s in zip(table.column("cells"), table.column("settled"), strict=True) if not s.as_py()]
    done = [_unpack(c.as_py(), all_but_first) for c, s in zip(table.column("cells"), table.column("settled"), strict=True) if s.as_py()]
    known, docs, places = [h for h, _, _ in done], [d for _, d, _ in done], [p for _, _, p in done]
    if open_rows:
        hashes, doc, place = (np.concatenate([r[i] for r in open_rows]) for i in range(3))
        order, fresh, same = _in_order(hashes, doc, place)
        again = order[~same][_repeated(fresh[~same], all_but_first)]
        again = again[place[again] != _SETTLED]
        known.append(hashes[again])
        docs.append(doc[again])
        places.append(place[again])
    if not docs:
        return []
    doc, place = np.concatenate(docs), np.concatenate(places)
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    return _rows(doc % groups, True, np.concatenate(known)[order] if all_but_first else None, doc, place)


def _marked(docs: np.ndarray, before: np.ndarray, table: pa.Table, low: int, high: int, last: int, windows: np.ndarray | None = None) -> np.ndarray:
    """Words of a block from ``place - low`` up to ``place + high`` (exclusive) around the listed places of their documents.

    ``last``: so many words at the end of a document are never marked.  ``windows``: hashes of the block's windows; a place counts
    only where the row has the listed hash.  Without them rows that share an id are marked alike.
    """
    marks = np.zeros(int(before[-1]) + 1, np.int64)
    found = [_unpack(c.as_py(), windows is not None) for c in table.column("cells")]
    if found and len(docs):
        doc, place = np.concatenate([d for _, d, _ in found]), np.concatenate([p for _, _, p in found])
        place = np.where(place < 0, place - _NO_ID, place)
        order = np.argsort(docs, kind="stable")
        at, to = (np.searchsorted(docs[order], doc, side) for side in ("left", "right"))
        times = to - at  # 0: the document is in another block; over 1: rows that share an id
        row = order[np.repeat(at - np.cumsum(times) + times, times) + np.arange(times.sum())]
        place = np.repeat(place, times)
        if windows is not None:
            inside = place + WINDOW <= np.diff(before)[row]
            at = np.where(inside, before[:-1][row] + place, 0)
            here = inside & (windows[at] == np.repeat(np.concatenate([h for h, _, _ in found]), times)) if len(windows) else inside
            place, row = place[here], row[here]
        begin = np.maximum(place - low, 0)
        end = np.minimum(place + high, np.diff(before)[row] - last)
        some = begin < end
        base = before[:-1][row[some]]
        size = len(marks)
        marks += np.bincount(base + begin[some], minlength=size) - np.bincount(base + end[some], minlength=size)
    return np.cumsum(marks[:-1]) > 0


def _kept_texts(data, offsets, starts, ends, before, removed) -> list[bytes]:
    """Words that stay, joined by one space, of each text."""
    stays = ~removed
    stop = np.minimum(ends + 1, np.repeat(offsets[1:], np.diff(before)))  # with the white space after it
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[stays]] += 1
    edge[stop[stays]] -= 1
    inside = np.cumsum(edge[: len(data)], dtype=np.int8) > 0
    counts = np.concatenate([[0], np.cumsum(inside)])[offsets]
    spaced = np.where(WHITE[data[inside]], np.uint8(32), data[inside]).tobytes()
    return [spaced[a:b].rstrip(b" ") for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True)]


def without_repeats(docs: DataFrame) -> DataFrame:
    """Every text without its repeated passages: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay).

    Words are runs of bytes other than ASCII white space, unchanged.  A word goes if a window over it has the words of a
    window that starts earlier: in a smaller ``doc_id``, or earlier in the same document.  Null text has no words.  Rows that share an id
    have one order: a start is earlier by its place alone, and equal starts leave each other's words, so a repeated row loses nothing to its copy.
    Rows without an id are documents of their own, which come first, in the order of a hash of their text; equal ones are repeated rows.
    An empty table gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = F.coalesce("doc_id", F.xxhash64("text"))
    offset = F.when(F.col("doc_id").isNull(), F.lit(int(_NO_ID))).otherwise(F.lit(0))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(tasks, total // TEXT_BYTES) | 1
    targets = max(tasks, total // HASH_BYTES)
    schema = "target int, settled boolean, cells binary"

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for block in blocks(batch, "text"):
                words, before = word_hashes(block.column("text"))
                count = np.diff(before)
                place = np.arange(len(words)) - np.repeat(before[:-1], count)
                size = np.repeat(count, count)
                here = np.flatnonzero(_IN_COVER[place % PERIOD] & (place + ANCHOR <= size) & (size >= WINDOW))
                ids, offsets = (np.repeat(block.column(c).to_numpy(), count)[here] for c in ("doc_id", "offset"))
                parts.append((window_hashes(words, ANCHOR)[here], ids, place[here] + offsets))
            if parts:
                yield _batch(_dealt(*(np.concatenate([p[i] for p in parts]) for i in range(3)), targets, False))

    def compared(all_but_first: bool):
        def run(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_batch(_compared(table, groups, all_but_first))])

        return run

    def windows(texts: pa.Table, repeated: pa.Table) -> pa.Table:
        rows = []
        if repeated.num_rows:
            parts = []
            for batch in texts.to_batches():
                for block in blocks(batch, "text"):
                    words, before = word_hashes(block.column("text"))
                    ids = block.column("key").to_numpy()
                    begins = np.flatnonzero(_marked(ids, before, repeated, PERIOD - 1, 1, WINDOW - 1))
                    row = np.searchsorted(before, begins, side="right") - 1
                    offsets = block.column("offset").to_numpy()
                    parts.append((window_hashes(words, WINDOW)[begins], ids[row], begins - before[row] + offsets[row]))
            if parts:
                rows = _dealt(*(np.concatenate([p[i] for p in parts]) for i in range(3)), targets, True)
        return pa.Table.from_batches([_batch(rows)])

    def cut(texts: pa.Table, repeated: pa.Table) -> pa.Table:
        out = []
        for batch in texts.to_batches():
            for block in blocks(batch, "text"):
                data, offsets = flat(block.column("text"))
                starts, ends, before = word_bounds(data, offsets)
                hashed = window_hashes(word_hashes(block.column("text"))[0], WINDOW) if repeated.num_rows else np.zeros(0, np.uint64)
                removed = _marked(block.column("key").to_numpy(), before, repeated, 0, WINDOW, 0, hashed)
                lost = np.concatenate([[0], np.cumsum(removed)])[before]
                kept = _kept_texts(data, offsets, starts, ends, before, removed)
                out.append(pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(before)), pa.array(np.diff(lost)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"]))
        if not out:
            kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
            return pa.Table.from_batches([], schema=pa.schema(kinds))
        return pa.Table.from_batches(out)

    texts = docs.select(F.pmod(key, F.lit(groups)).cast("int").alias("target"), key.alias("key"), offset.alias("offset"), "doc_id", "text").groupBy("target")
    found = docs.select(key.alias("doc_id"), offset.alias("offset"), "text").mapInArrow(anchors, schema)
    repeated = found.groupBy("target").applyInArrow(compared(False), schema)
    opened = texts.cogroup(repeated.groupBy("target")).applyInArrow(windows, schema)
    later = opened.groupBy("target").applyInArrow(compared(True), schema)
    return texts.cogroup(later.groupBy("target")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
