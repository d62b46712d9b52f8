"""Near-duplicate documents by HyperMinHash.

A document is the set of its word shingles.  Of the 64-bit hashes of a set, the first bits name one of ``REGISTERS``
buckets, and a bucket keeps its smallest remainder as a leading-zero count and ``MANTISSA`` bits after the first one
bit: 16 bits a bucket.  Documents whose registers agree in a whole band share a key; in each key the similarity is estimated
from equal registers, less the equalities expected by chance, and only likely pairs go on.  They are
then confirmed on the whole sets.

No list of pairs is made.  A key gives a spanning forest of its likely pairs, these give groups, and inside a group the
exact comparison gives a spanning forest of the confirmed links: as many rows as documents, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.functions.skew import attach
from tracklume.llm.linked import smallest_of_component
from tracklume.llm.text import blocks, mix, window_hashes, word_hashes
from tracklume.sources.tables import stored

REGISTERS, BAND, MANTISSA = 128, 4, 10
KEY_ROWS = 8192  # documents of one key that a task compares at once; a larger key is compared block by block
PART_SHINGLES, PART_ROWS = 200_000, 256  # of one group in a task; a larger group is cut into parts that each meet one of its documents
GROUP_SHINGLES = 8_000_000  # shingles of a part on either side where what that document does not tie meets the whole group
_BUCKET_BITS = REGISTERS.bit_length() - 1


def shingles_of(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than ``size`` the whole sequence is one shingle."""
    words, before = word_hashes(column, lower=True)
    windows = window_hashes(words, size)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        elif n:
            out.append(window_hashes(words[a:b], n) ^ np.uint64(n))
        else:
            out.append(words[:0])
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted distinct hashes; 0 is an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        spread = np.sort(mix(shingles))
        bucket = (spread >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest = spread[first] << np.uint64(_BUCKET_BITS)
        zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 57).astype(np.uint64)
        mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        out[bucket[first]] = (zeros << np.uint64(MANTISSA) | mantissa) + np.uint64(1)
    return out


def chance_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers of two unrelated sets of these sizes that are expected to be equal by chance (Yu and Weber, 2017)."""
    ratio = n / m
    return 0.169919487159739 * 2.0 ** (_BUCKET_BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2


def likely(own: np.ndarray, n: int, others: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Which of ``others`` may reach the similarity: the corrected estimate is at most five standard errors below it."""
    used = (others != 0) | (own != 0)
    equal = ((others == own) & used).sum(axis=1)
    compared = used.sum(axis=1)
    estimate = (equal - chance_collisions(np.float64(n), m)) / compared
    return estimate >= least - 5 * np.sqrt(least * (1 - least) / compared)


def _key_forest(ids: np.ndarray, sizes: np.ndarray, regs: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Spanning forest of the likely pairs of one key: each found document is compared with those not yet reached."""
    edges = []
    left = np.arange(len(ids))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = likely(regs[x], int(sizes[x]), regs[left], sizes[left], least)
            if hit.any():
                new = left[hit]
                edges += [(int(ids[x]), int(i)) for i in ids[new]]
                front += new.tolist()
                left = left[~hit]
    return edges


def _link_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of sets with ``100 * |A and B| >= percent * |A or B|``, as places in the list."""
    sizes = np.asarray([len(s) for s in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool)
    ends = np.cumsum(sizes)
    edges = []
    rows = np.flatnonzero(sizes)  # not yet reached; an empty set links with nothing
    cells, starts = codes, (ends - sizes)[rows]

    def without(rows, cells, starts, stay):
        length = sizes[rows]
        return rows[stay], cells[np.repeat(stay, length)], (np.cumsum(length[stay]) - length[stay])

    while len(rows) > 1:
        front = [int(rows[0])]
        rows, cells, starts = without(rows, cells, starts, np.arange(len(rows)) > 0)
        while front and len(rows):
            x = front.pop()
            own = codes[ends[x] - sizes[x] : ends[x]]
            mark[own] = True
            common = np.add.reduceat(mark[cells], starts, dtype=np.int64)
            mark[own] = False
            hit = 100 * common >= percent * (sizes[x] + sizes[rows] - common)
            if hit.any():
                new = rows[hit].tolist()
                edges += [(x, i) for i in new]
                front += new
                rows, cells, starts = without(rows, cells, starts, ~hit)
    return edges


def _pair_batches(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each key of sorted batches, one table a key."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[at] for c in columns)
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(at, to - at))
            last = key
    if kept:
        yield pa.Table.from_batches(kept)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, a 128-bit hash of the set (``sa``, ``sb``) and its ``regs``, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = shingles_of(block.column("text"), size)
                # sums over distinct hashes do not depend on their order
                sa = [int(s.sum(dtype=np.uint64)) - (1 << 63) if len(s) else 0 for s in sets]
                sb = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) - (1 << 63) if len(s) else 0 for s in sets]
                regs = [registers(s).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sa, pa.int64()), pa.array(sb, pa.int64()), pa.array(regs, pa.binary())],
                    ["doc_id", "n_shingles", "sa", "sb", "regs"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sa long, sb long, regs binary")


def likely_groups(reps: DataFrame, percent: int) -> DataFrame:
    """Groups of documents tied by likely pairs: ``rep``, ``label``, only documents that have a partner."""
    least = percent / 100

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS // BAND, BAND)
            key = np.zeros(regs.shape[:2], np.uint64)
            for i in range(BAND):
                key = key * np.uint64(1 << 16) + regs[:, :, i]
            some = key != 0
            key = mix(mix(key) + np.arange(regs.shape[1], dtype=np.uint64)[None, :])
            rep = np.broadcast_to(batch.column("rep").to_numpy()[:, None], key.shape)
            yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(rep[some])], ["key", "rep"])

    keyed = reps.select("rep", "regs").mapInArrow(bands, "key long, rep long")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    tied = keyed.join(shared, "key").join(reps.select("rep", "n_shingles", "regs"), "rep")
    # a larger key is compared block by block, each part with each other part: exact, but quadratic in the parts of the key
    parts = F.when(F.col("size") > KEY_ROWS, F.ceil(2 * F.col("size") / KEY_ROWS)).otherwise(F.lit(1)).cast("long")
    part = F.pmod(F.xxhash64("rep", "key"), F.col("parts"))
    blocks_of = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    placed = tied.withColumn("parts", parts).withColumn("part", part).select("key", F.explode(blocks_of).alias("at"), "rep", "n_shingles", "regs")
    placed = placed.select("key", "at.i", "at.j", "rep", "n_shingles", "regs")
    keys = ["key", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for table in _runs(batches, keys):
            if table.num_rows > 1:
                regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                edges += _key_forest(table.column("rep").to_numpy(), table.column("n_shingles").to_numpy(), regs, least)
            if len(edges) > 50_000:
                yield _pair_batches(edges)
                edges = []
        if edges:
            yield _pair_batches(edges)

    links = placed.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(compare, "a long, b long")
    groups = smallest_of_component(links)
    return groups.select(F.col("node").alias("rep"), "label").union(groups.select(F.col("label").alias("rep"), "label").distinct())


def _first_of_component(n: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """Component of each of ``n`` places by a forest of :func:`_link_forest`, whose edges start where the forest has already been."""
    top = list(range(n))
    for x, y in edges:
        top[y] = top[x]
    return np.asarray(top, np.int64)


def _compared(texts: DataFrame, keys: list[str], size: int, percent: int) -> DataFrame:
    """Forest of the links among the rows of each key: ``label``, ``a``, ``b``; ``b`` is null for a row that nothing ties to ``pivot``.

    ``texts`` has the keys, the first of them ``label``, with ``rep``, ``text`` and ``pivot``, null where no such rows are wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[int] = []
        edges: list[tuple[int, int | None]] = []

        def batch_of():
            a, b = zip(*edges, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (labels, a, b)], ["label", "a", "b"])

        for table in _runs(batches, keys):
            sets, ids = [], []
            for batch in table.select(["rep", "text"]).to_batches():
                for block in blocks(batch, "text"):
                    sets += shingles_of(block.column("text"), size)
                    ids += block.column("rep").to_pylist()
            pivot = table.column("pivot")[0].as_py()
            forest = _link_forest(sets, percent) if len(ids) > 1 else []
            found = [(ids[x], ids[y]) for x, y in forest]
            if pivot is not None:
                top = _first_of_component(len(ids), forest)
                found += [(ids[i], None) for i in np.flatnonzero(top != top[ids.index(pivot)]).tolist()]
            edges += found
            labels += [table.column("label")[0].as_py()] * len(found)
            if len(edges) > 50_000:
                yield batch_of()
                labels, edges = [], []
        if edges:
            yield batch_of()

    rows = texts.select(*keys, "rep", "text", "pivot")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(run, "label long, a long, b long")


def confirmed_links(docs: DataFrame, groups: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Spanning forest of the links that hold on the whole sets, from comparisons inside each group: ``a``, ``b``.

    A large group is cut into parts, and one of its documents, of about the mean size, goes to each of them.  Documents of two
    parts that both are tied to it need not meet.  Only those that are not tied to it meet the other parts, in blocks: no link is lost, and the work
    is quadratic only in them.
    """
    sized = groups.join(reps.select("rep", "n_shingles"), "rep")
    most = groups.count()  # rows of a label at most
    total = F.sum("n_shingles")
    ways = F.ceil(F.greatest(total / PART_SHINGLES, F.count(F.lit(1)) / PART_ROWS)).cast("long")
    stats = sized.groupBy("label").agg(F.count(F.lit(1)).alias("n"), total.alias("total"), F.avg("n_shingles").alias("mean"), ways.alias("parts"))
    sized = stored(attach(sized, stats, ["label"], "n", ["rep"], most=most).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))), "sized")
    large = F.col("parts") > 1
    middle = sized.where(large).groupBy("label").agg(F.min_by("rep", F.struct(F.abs(F.col("n_shingles") - F.col("mean")), F.col("rep"))).alias("pivot"), F.count(F.lit(1)).alias("n"))
    placed = sized.where(~large).select("label", "part", "rep", F.lit(None).cast("long").alias("pivot"), F.lit(True).alias("home")).unionByName(
        attach(sized.where(large).drop("n"), middle, ["label"], "n", ["rep"], most=most)
        .withColumn("at", F.explode(F.when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("part"))))
        .select("label", F.col("at").alias("part"), "rep", "pivot", (F.col("at") == F.col("part")).alias("home"))
    )
    # the texts of groups are written, so that those of other documents move only once
    texts = stored(docs.join(placed, docs.doc_id == placed.rep).select(*placed.columns, "text"), "texts")
    first = stored(_compared(texts, ["label", "part"], size, percent), "first")
    links = first.where("b is not null").select("a", "b")
    loose = sized.join(first.where("b is null").select(F.col("a").alias("rep")), "rep", "left_semi").select("label", "rep", "n_shingles")
    if loose.isEmpty():
        return links
    # copies of a block stay below the size of the group as long as what is loose fits one block
    held = loose.groupBy("label").agg(F.sum("n_shingles").alias("held"))
    sides = sized.where(large).groupBy("label").agg(F.first("total").alias("total"), F.first("parts").alias("parts"), F.count(F.lit(1)).alias("n")).join(held, "label")
    fewest = F.ceil(F.col("total") / GROUP_SHINGLES)
    sides = sides.select("label", "n", F.least("parts", F.greatest(fewest, F.ceil(F.col("total") / F.col("held")))).cast("long").alias("rows"), F.ceil(F.col("held") / GROUP_SHINGLES).cast("long").alias("columns"))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    own = F.xxhash64("rep", F.lit(1))
    there = attach(sized.where(large).select("label", "rep"), sides, ["label"], "n", ["rep"], most=most).select("label", "rep", F.pmod(own, F.col("rows")).alias("i"), every("columns").alias("j"))
    here = attach(loose.select("label", "rep"), sides, ["label"], "n", ["rep"], most=most).select("label", "rep", F.pmod(own, F.col("columns")).alias("j"), every("rows").alias("i"))
    met = there.unionByName(here).distinct().withColumn("pivot", F.lit(None).cast("long"))
    again = texts.where("pivot is not null and home").select("rep", "text").join(met, "rep")
    return links.union(_compared(again, ["label", "i", "j"], size, percent).select("a", "b"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Component of near-duplicates of every document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Words are runs of bytes other than ASCII white space, with A-Z as a-z; shingles are ``size`` words.  Two documents are linked if
    ``100 * |A and B| >= percent * |A or B|``.  ``component_id`` is the smallest ``doc_id`` that can be reached, ``kept`` marks the document
    with that id.  Documents without words (null, empty, white space) link with nothing.  Ids are taken to be unique: rows that share an
    id are one node.  Rows with a null id take no part; they are kept and have no component.  An empty table gives
    no row; other columns are not read.

    A pair at the similarity bound is missed by all 32 bands with a probability of about 5e-8 and by the estimate, at five standard
    errors, with about 1.4e-6.  Texts are compared whole, however long.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stored(signed(docs, size), "sets")
    filled = sets.where("n_shingles > 0 and doc_id is not null")
    reps = stored(filled.groupBy("sa", "sb", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs")), "reps")
    groups = stored(likely_groups(reps, percent), "groups")
    labels = smallest_of_component(confirmed_links(docs, groups, reps, size, percent))
    found = reps.join(labels, reps.rep == labels.node, "left").select("sa", "sb", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    usable = F.col("doc_id").isNotNull()
    placed = (
        sets.where("n_shingles > 0").drop("regs").join(found, ["sa", "sb", "n_shingles"], "left")
        .unionByName(sets.where("n_shingles = 0").drop("regs").withColumn("component_id", F.col("doc_id")))
        .withColumn("component_id", F.when(usable, F.col("component_id")))
    )
    return placed.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
