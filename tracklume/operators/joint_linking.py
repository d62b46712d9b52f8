"""Detections into tracks by joint assignment: in each frame, the links with the least total cost.

In every frame the open tracks (those last seen at most ``memory`` frames ago) meet the new detections.  A link within ``reach`` costs
its squared distance and an open track that gets none costs ``reach`` squared; the cheapest set of links is taken.  What is open in the
next frame depends on it, so this is a recurrence over frames.  It only couples detections that chains of possible links connect:

* occupied squares of side ``reach`` are the nodes of a graph over all frames, squares that may hold a link are its edges (at most nine
  per square and gap, however crowded a square is), and its components are solved apart from each other, many in one call;
* a component of more than ``JOINT_ROWS`` detections is solved frame by frame: the squares of one frame fall into much smaller
  sub-networks, which are solved side by side, and the open tracks are a written table.

Both ways give the same links.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.operators.graph import components
from tracklume.sources.tables import discard, new_location, stored

JOINT_ROWS = 200_000
_CALL_ROWS = 50_000
_LEAST_CALLS = 64
_PLACE = ("file", "frame", "bx", "by")


def cheapest(costs: Sequence[Mapping[int, float]], skip: float) -> list[int | None]:
    """For each row the column it gets, or None at the cost ``skip``, so that the total is least.

    ``costs`` lists the possible columns of each row.  Rows come in one after the other, each by a shortest augmenting path under
    potentials, which only walks through rows that compete with it.  Equal totals are settled by the order of rows and columns.
    """
    n = 1 + max((j for row in costs for j in row), default=-1)
    u: list[float] = [0.0] * len(costs)
    v: dict[int, float] = defaultdict(float)
    owner: dict[int, int] = {}  # column -> row; column n + i is "row i gets none"
    held: dict[int, int] = {}  # row -> column
    for start in range(len(costs)):
        length: dict[int, float] = {}
        came: dict[int, int] = {}
        done: dict[int, float] = {}
        queue: list[tuple[float, int]] = []
        row, base = start, 0.0
        while True:
            for j, cost in [*costs[row].items(), (n + row, skip)]:
                reached = base + cost - u[row] - v[j]
                if j not in done and reached < length.get(j, math.inf):
                    length[j], came[j] = reached, row
                    heapq.heappush(queue, (reached, j))
            base, j = heapq.heappop(queue)
            while j in done:
                base, j = heapq.heappop(queue)
            done[j] = base
            if j not in owner:
                break
            row = owner[j]
        u[start] += base
        for column, at in done.items():
            if column != j:
                u[owner[column]] += base - at
                v[column] -= base - at
        while True:
            row = came[j]
            before = held.get(row)
            owner[j], held[row] = row, j
            if before is None:
                break
            j = before
    return [j if j < n else None for _, j in sorted(held.items())]


def _step(open_at: Sequence[tuple[float, float]], new_at: Sequence[tuple[float, float]], reach: float) -> list[int | None]:
    """For each open track the new detection it goes on with, or None."""
    squares: dict[tuple[int, int], list[int]] = defaultdict(list)
    for j, (x, y) in enumerate(new_at):
        squares[math.floor(x / reach), math.floor(y / reach)].append(j)
    costs = []
    for x, y in open_at:
        bx, by = math.floor(x / reach), math.floor(y / reach)
        near = (j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in squares.get((bx + dx, by + dy), ()))
        squared = {j: (new_at[j][0] - x) ** 2 + (new_at[j][1] - y) ** 2 for j in near}
        costs.append({j: c for j, c in sorted(squared.items()) if c <= reach * reach})
    return cheapest(costs, reach * reach)


def _recurrence(spots: Iterable[tuple[int, int, float, float]], reach: float, memory: int) -> Iterator[tuple[int, int]]:
    """Links of one component, frame after frame; ``spots`` are (frame, id, x, y) in this order."""
    live: dict[int, tuple[float, float, int]] = {}
    for frame, here in groupby(spots, key=itemgetter(0)):
        live = {a: at for a, at in sorted(live.items()) if frame - at[2] <= memory + 1}
        rows = list(here)
        ids, places = [row[1] for row in rows], [row[2:] for row in rows]
        for a, j in zip(list(live), _step([at[:2] for at in live.values()], places, reach)):
            if j is not None:
                del live[a]
                yield a, ids[j]
        live.update((d, (x, y, frame)) for d, (x, y) in zip(ids, places))


def _table(links: Sequence[tuple]) -> pd.DataFrame:
    file, a, b = zip(*links) if links else ((), (), ())
    return pd.DataFrame({"file": pd.Series(file, dtype=object), "a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})


def _with_squares(spots: DataFrame, reach: float) -> DataFrame:
    def square(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(reach)).cast("long")

    return spots.withColumns({"bx": square("x"), "by": square("y")})


def _squares(spots: DataFrame) -> DataFrame:
    """Occupied squares, named by their smallest detection."""
    return spots.groupBy(*_PLACE).agg(F.min("det_id").alias("node"))


def _edges(first: DataFrame, second: DataFrame) -> DataFrame:
    """Squares of ``second`` around squares of ``first`` in the same frame."""
    around = F.sequence(F.lit(-1), F.lit(1))
    spread = first.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    spread = spread.select("file", "frame", (F.col("bx") + F.col("_dx")).alias("bx"), (F.col("by") + F.col("_dy")).alias("by"), F.col("node").alias("a"))
    return spread.join(second.withColumnRenamed("node", "b").hint("merge"), list(_PLACE)).select("file", "a", "b")


def _named(spots: DataFrame, squares: DataFrame, labels: DataFrame) -> DataFrame:
    """``spots`` with the component ``net`` of their square.  All tables grow with the detections, so none is broadcast."""
    nets = squares.join(labels.withColumnRenamed("label", "net").hint("merge"), ["file", "node"]).drop("node")
    return spots.join(nets.hint("merge"), list(_PLACE)).drop("bx", "by")


def _by_frame(spots: DataFrame, reach: float, memory: int) -> DataFrame:
    """Links of components that are too large for one task: a few jobs per frame, each over the sub-networks of that frame."""
    spark = spots.sparkSession
    # in ranges of frames, so that reading a frame skips the other files
    spots = stored(spots.repartitionByRange("frame", "det_id"), "spots")
    schema = spots.select("file", F.col("det_id").alias("a"), F.col("det_id").alias("b")).schema

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("det_id")
        old, new = pdf[pdf.old], pdf[~pdf.old]
        found = _step(list(zip(old.x, old.y)), list(zip(new.x, new.y)), reach)
        return _table([(pdf.file.iloc[0], a, new.det_id.iloc[j]) for a, j in zip(old.det_id, found) if j is not None])

    path, live = new_location(spark, "joint-links"), None
    numbers = [r.frame for r in spots.select("frame").distinct().orderBy("frame").collect()]  # a number per frame
    for number in numbers:
        here = spots.where(F.col("frame") == number)
        opened = here.withColumn("last", F.col("frame"))
        if live is None:
            live = stored(opened, "live")
            continue
        before = live
        meeting = live.where(number - F.col("last") <= memory + 1).withColumn("frame", F.lit(number).cast(spots.schema["frame"].dataType))
        old, new = _squares(_with_squares(meeting, reach)), _squares(_with_squares(here, reach))
        nodes = old.unionByName(new)
        labels = components(nodes.select("file", "node"), _edges(old, new), ["file"])
        columns = ["file", "frame", "det_id", "x", "y"]
        rows = _named(_with_squares(meeting.select(*columns), reach), old, labels).withColumn("old", F.lit(True))
        rows = rows.unionByName(_named(_with_squares(here.select(*columns), reach), new, labels).withColumn("old", F.lit(False)))
        rows.groupBy("file", "net").applyInPandas(solved, schema).write.parquet(f"{path}/at={number}")
        links = spark.read.schema(schema).parquet(f"{path}/at={number}")
        waiting = meeting.join(links.select("file", F.col("a").alias("det_id")).hint("merge"), ["file", "det_id"], "left_anti")
        live = stored(waiting.select(*opened.columns).unionByName(opened), "live")
        discard(before)
    if len(numbers) < 2:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/at={number}" for number in numbers[1:]])


def joint_links(spots: DataFrame, reach: float = 20.0, memory: int = 3, limit: int = JOINT_ROWS) -> DataFrame:
    """Links ``a`` to ``b`` of the cheapest assignment of each frame: (file, a, b).

    ``det_id`` is unique in a file.  Detections without a file, id, frame or position take no part.  Of assignments with the same
    total the one that the order of ids gives is taken.
    """
    placed = spots.select("file", "frame", "det_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    placed = _with_squares(placed.where((F.abs("x") < math.inf) & (F.abs("y") < math.inf)), reach)
    squares = stored(_squares(placed), "squares")
    gaps = squares.withColumn("_gap", F.explode(F.sequence(F.lit(1), F.lit(memory + 1)))).withColumn("frame", F.col("frame") + F.col("_gap"))
    labels = components(squares.select("file", "node"), _edges(gaps.drop("_gap"), squares), ["file"])
    named = stored(_named(placed, squares, labels), "nets")
    # at most rows / limit entries
    large = stored(named.groupBy("file", "net").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("file", "net"), "large")
    schema = named.select("file", F.col("det_id").alias("a"), F.col("det_id").alias("b")).schema

    # many components a task call: most are small, and a call costs more than they do
    calls = max(_LEAST_CALLS, math.ceil(named.count() / _CALL_ROWS))

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["file", "net", "frame", "det_id"])
        rows = zip(pdf.file, pdf.net, pdf.frame, pdf.det_id, pdf.x, pdf.y)
        return _table([(file, a, b) for (file, _), part in groupby(rows, key=itemgetter(0, 1)) for a, b in _recurrence((row[2:] for row in part), reach, memory)])

    call = F.pmod(F.xxhash64("file", "net"), F.lit(calls))
    links = named.join(F.broadcast(large), ["file", "net"], "left_anti").groupBy(call).applyInPandas(solved, schema)
    if large.isEmpty():
        return links
    return links.unionByName(_by_frame(named.join(F.broadcast(large), ["file", "net"], "left_semi").drop("net"), reach, memory))


def joint_tracks(spots: DataFrame, reach: float = 20.0, memory: int = 3, limit: int = JOINT_ROWS) -> DataFrame:
    """Detections with the track they belong to, named by its smallest detection; links by joint assignment."""
    links = joint_links(spots, reach, memory, limit)
    labels = components(spots.select("file", F.col("det_id").alias("node")), links, ["file"])
    named = labels.select("file", F.col("node").alias("det_id"), F.col("label").alias("track"))
    return spots.join(named.hint("merge"), ["file", "det_id"])
