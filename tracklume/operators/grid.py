"""Masks as tables of cells (file, frame, x, y): thresholds, components, boundaries, shape measures and distances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklume.functions.scalars import ratio
from tracklume.functions.skew import attach
from tracklume.operators.graph import components
from tracklume.sources.tables import stored

GRID = ["file", "frame"]


def rescaled(df: DataFrame, keys: Sequence[str], value: str, spread_by: Sequence[str]) -> DataFrame:
    """Value relative to the range of its group."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"), F.count(F.lit(1)).alias("_size"))
    return (
        attach(df, span, keys, "_size", spread_by)
        .withColumn("rescaled", ratio(F.col(value) - F.col("_min"), F.col("_max") - F.col("_min")))
        .drop("_min", "_max", "_size")
    )


def otsu_limits(df: DataFrame, keys: Sequence[str], value: str, bins: int = 32) -> DataFrame:
    """Two thresholds per group that split its histogram into the three classes with the largest variance between them.

    The histogram has ``bins`` equal bins over the range of the group; a threshold is the centre of the last bin of its
    class.  Equal values are merged first.  Only bin counts are collected per group, at most ``bins`` of them, and all pairs of thresholds are compared
    as one matrix of that short array.  Of equally good pairs the first one counts.
    """
    merged = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_times"))
    span = merged.groupBy(*keys).agg(
        F.min(value).alias("_min"), F.max(value).alias("_max"), F.count(F.lit(1)).alias("_size")
    )
    width = (F.col("_max") - F.col("_min")) / bins
    place = F.coalesce(F.floor(ratio(F.col(value) - F.col("_min"), width)), F.lit(0))
    binned = attach(merged, span, keys, "_size", [value]).withColumn(
        "_bin", F.least(place, F.lit(bins - 1)).cast("int")
    )
    counts = binned.groupBy(*keys, "_min", "_max", "_bin").agg(F.sum("_times").alias("_n"))
    listed = counts.groupBy(*keys, "_min", "_max").agg(
        F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_by_bin")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.coalesce(F.try_element_at("_by_bin", b), F.lit(0)).cast("double"),
    )
    best = _best_pair(F.col("_h"))
    centre = (F.col("_max") - F.col("_min")) / bins
    return (
        listed.withColumn("_h", dense)
        .withColumn("_best", best)
        .select(
            *keys,
            (F.col("_min") + (F.col("_best.i") + 0.5) * centre).alias("lower"),
            (F.col("_min") + (F.col("_best.j") + 0.5) * centre).alias("upper"),
        )
    )


@F.pandas_udf(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))
def _best_pair(histograms: pd.Series) -> pd.DataFrame:
    """Last bins of the first two of three classes with the largest variance between them; of equally good pairs the first."""
    found = []
    for histogram in histograms:
        n = np.cumsum(histogram)
        s = np.cumsum(np.asarray(histogram) * np.arange(1, len(histogram) + 1))

        def part(count, total):
            return np.divide(total * total, count, out=np.zeros_like(count), where=count > 0)

        first, last = part(n, s), part(n[-1] - n, s[-1] - s)
        middle = part(n[None, :] - n[:, None], s[None, :] - s[:, None])
        between = np.round(first[:, None] + middle + last[None, :], 6)
        i, j = np.triu_indices(len(n) - 1, 1)
        at = int(between[i, j].argmax())
        found.append((int(i[at]), int(j[at])))
    return pd.DataFrame(found, columns=["i", "j"])


def above_lower(
    df: DataFrame, keys: Sequence[str], value: str, spread_by: Sequence[str], bins: int = 32
) -> DataFrame:
    """Rows with ``mask``: whether the value lies above the lower of the two thresholds of its group."""
    limits = otsu_limits(df, keys, value, bins)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    rows = attach(df, limits.join(sizes, list(keys)), keys, "_size", spread_by)
    return rows.withColumn("mask", F.col(value) > F.col("lower")).drop("_size", "upper")


def _tile_labels(cells: pd.DataFrame) -> pd.DataFrame:
    """Number of the 4-connected component of every cell of one tile: ``y * 2**24 + x`` of its first cell.

    Bits of x beyond 24 stand above those of y, so every pair of 32-bit numbers, negative ones too, has a number of its own.

    Horizontal runs are joined with the runs they touch in the line before.
    """
    cells = cells.sort_values(["y", "x"], ignore_index=True)
    x, y = cells["x"].to_numpy(np.int64), cells["y"].to_numpy(np.int64)
    opens = np.ones(len(x), dtype=bool)
    opens[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    run = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(x)) - 1
    line, low, high = y[first].tolist(), x[first].tolist(), x[last].tolist()
    parent = list(range(len(first)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above = 0
    for i in range(len(first)):
        while line[above] < line[i] - 1 or (line[above] == line[i] - 1 and high[above] < low[i]):
            above += 1
        j = above
        while line[j] == line[i] - 1 and low[j] <= high[i]:
            a, b = root(j), root(i)
            parent[max(a, b)] = min(a, b)
            j += 1
    top = np.array([root(i) for i in range(len(first))])
    number = ((x >> 24) << 56) + (y << 24) + (x & 0xFFFFFF)
    cells["label"] = number[first][top][run]
    return cells[[*GRID, "x", "y", "label"]]


def labelled_cells(cells: DataFrame, tile: int = 1024) -> DataFrame:
    """Cells with the number of their 4-connected component and its size.

    A grid is cut into tiles of ``tile`` times ``tile`` cells, which bounds what one task sees.  Components are found
    inside the tiles first; only the cells along tile borders and the components they belong to are then connected.
    """
    kept = [cells.schema[c] for c in (*GRID, "x", "y")]
    schema = T.StructType([*kept, T.StructField("label", T.LongType())])
    tiled = cells.select(*GRID, "x", "y").withColumns(
        {"_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)}
    )
    local = stored(tiled.groupBy(*GRID, "_tx", "_ty").applyInPandas(_tile_labels, schema), "tiles")
    sides = []
    for axis in ("x", "y"):
        here = local.where(F.pmod(axis, F.lit(tile)) == 0).withColumnRenamed("label", "a")
        there = local.where(F.pmod(axis, F.lit(tile)) == tile - 1).select(
            *GRID, *[(F.col(c).cast("long") + 1).alias(c) if c == axis else F.col(c) for c in ("x", "y")], F.col("label").alias("b")
        )
        sides.append(here.join(there, [*GRID, "x", "y"]).select(*GRID, "a", "b"))
    edges = stored(sides[0].union(sides[1]).distinct(), "borders")
    if not edges.isEmpty():
        nodes = edges.select(*GRID, F.col("a").alias("node")).union(edges.select(*GRID, F.col("b").alias("node")))
        merged = components(nodes, edges, GRID).withColumnsRenamed({"label": "_whole", "node": "label"})
        # at most one tile of cells shares a label here
        local = local.join(merged, [*GRID, "label"], "left").select(
            *GRID, "x", "y", F.coalesce("_whole", "label").alias("label")
        )
    sizes = local.groupBy(*GRID, "label").agg(F.count(F.lit(1)).alias("size"))
    return attach(local, sizes, [*GRID, "label"], "size", ["x", "y"])


def background(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Cells of every grid that are not set, for grids of ``width`` times ``height`` cells."""
    lines = cells.select(*GRID).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    whole = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return whole.join(cells.select(*GRID, "x", "y"), [*GRID, "x", "y"], "left_anti").select(*GRID, "x", "y")


def without_specks(cells: DataFrame, min_size: int) -> DataFrame:
    """Cells of the components with at least ``min_size`` cells."""
    return labelled_cells(cells).where(F.col("size") >= min_size).select(*GRID, "x", "y")


def without_holes(cells: DataFrame, max_hole: int, width: int, height: int) -> DataFrame:
    """Cells together with the background components smaller than ``max_hole``."""
    holes = labelled_cells(background(cells, width, height)).where(F.col("size") < max_hole)
    return cells.select(*GRID, "x", "y").union(holes.select(*GRID, "x", "y"))


def disk(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dx, dy) for dx in span for dy in span if dx * dx + dy * dy <= radius * radius]


def boundary(cells: DataFrame, radius: int = 3, shape: tuple[int, int] | None = None) -> DataFrame:
    """Cells that erosion by a disk removes: those with a cell of the disk around them unset.

    Every cell is counted for each cell whose disk it lies in: one aggregation, no join.  With ``shape`` (width,
    height), cells beyond the edge of the image count as set.
    """
    offsets = disk(radius)
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    spread = cells.select(*GRID, F.col("x").alias("_x"), F.col("y").alias("_y"), F.inline(shifts)).select(
        *GRID,
        (F.col("_x") + F.col("dx")).alias("x"),
        (F.col("_y") + F.col("dy")).alias("y"),
        ((F.col("dx") == 0) & (F.col("dy") == 0)).cast("int").alias("_own"),
    )
    counted = spread.groupBy(*GRID, "x", "y").agg(F.count(F.lit(1)).alias("_n"), F.max("_own").alias("_own"))
    needed = F.lit(len(offsets))
    if shape is not None:
        inside = [
            F.when((F.col("x") + dx).between(0, shape[0] - 1) & (F.col("y") + dy).between(0, shape[1] - 1), 1).otherwise(0)
            for dx, dy in offsets
        ]
        needed = sum(inside[1:], inside[0])
    return counted.where((F.col("_own") == 1) & (F.col("_n") < needed)).select(*GRID, "x", "y")


def morphology(cells: DataFrame, edges: DataFrame, pixel: float, perimeter_power: int = 2) -> DataFrame:
    """Area and perimeter of the mask per frame; the perimeter is scaled like the area unless the power is set to 1."""
    area = cells.groupBy(*GRID).agg((F.count(F.lit(1)) * F.lit(pixel * pixel)).alias("area"))
    rim = edges.groupBy(*GRID).agg(F.count(F.lit(1)).alias("perimeter_au"))
    return area.join(rim, GRID, "left").select(
        *GRID,
        "area",
        F.coalesce("perimeter_au", F.lit(0)).alias("perimeter_au"),
        (F.coalesce("perimeter_au", F.lit(0)) * F.lit(pixel**perimeter_power)).alias("perimeter"),
    )


def _reach(spots: DataFrame, points: DataFrame) -> int:
    """A bound on the distance of any spot from any point of its grid: one aggregate over both."""
    both = spots.select(*GRID, "x", "y").unionByName(points.select(*GRID, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    spans = both.groupBy(*GRID).agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("x", "y")])
    return int(spans.agg(F.coalesce(F.max(F.greatest("x", "y")), F.lit(0.0)).alias("span")).first().span) + 1


def nearest_distance(spots: DataFrame, points: DataFrame, extent: int | None = None, pixel: float = 1.0) -> DataFrame:
    """Distance of every spot to the nearest of the ``points`` (whole cells) of its grid, without meeting all of them.

    Spots of one cell share a list of points, so all but the last step works on distinct cells.  The plane is cut into squares of side 1, 2, 4, ... up to
    ``extent``, the largest possible distance along an axis (taken from the data if not given).  At the smallest side at which one of the nine squares around
    a cell is occupied, the points in those squares bound the distance of all its spots; the list has the points of any square that can be as near as one spot of the cell.
    A spot has no distance only if its grid has no point.
    """
    extent = _reach(spots, points) if extent is None else extent
    sides = max(extent, 1).bit_length() + 1
    level = F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))
    side = F.pow(F.lit(2.0), F.col("level"))

    def square(c: Column | str) -> Column:
        return F.floor((F.col(c) if isinstance(c, str) else c) / side).cast("long")

    def spread(df: DataFrame, x: Column, y: Column) -> DataFrame:
        return df.withColumn("bx", F.explode(x)).withColumn("by", F.explode(y))

    def beside(c: str) -> Column:
        return F.sequence(F.col(c) - 1, F.col(c) + 1)

    def least(c: str, p: str) -> Column:
        return F.greatest(F.col(p) - F.col(c) - 1, F.col(c) - F.col(p), F.lit(0)).cast("double")

    def most(c: str, p: str) -> Column:
        return F.greatest(F.col(p) - F.col(c), F.col(c) + 1 - F.col(p)).cast("double")

    cell, squares = [*GRID, "cx", "cy"], [*GRID, "level", "bx", "by"]
    placed = spots.withColumns({"cx": F.floor("x").cast("long"), "cy": F.floor("y").cast("long")})
    asked = placed.select(*cell).distinct()
    leveled = points.select(*GRID, F.col("x").alias("px"), F.col("y").alias("py")).withColumn("level", level).withColumns({"bx": square("px"), "by": square("py")})
    occupied = leveled.select(*GRID, "level", F.col("bx").alias("sx"), F.col("by").alias("sy")).distinct()
    near = spread(occupied, beside("sx"), beside("sy")).select(*squares).distinct()
    searching = asked.withColumn("level", level).withColumns({"bx": square("cx"), "by": square("cy")})
    chosen = stored(searching.join(near.hint("merge"), squares).groupBy(*cell).agg(F.min("level").alias("level")), "chosen")
    wanted = chosen.select(*GRID, "level").distinct()
    known = leveled.join(wanted.hint("merge"), [*GRID, "level"], "left_semi")
    middle = chosen.withColumns({"sx": square("cx"), "sy": square("cy")})
    # one point of the nine squares is enough for a bound on all spots of the cell
    bounded = (
        spread(middle, beside("sx"), beside("sy"))
        .join(known.hint("merge"), squares)
        .groupBy(*cell, "level")
        .agg(F.min(most("cx", "px") * most("cx", "px") + most("cy", "py") * most("cy", "py")).alias("bound"))
    )
    far = F.ceil(F.sqrt("bound"))
    targets = spread(bounded, *[F.sequence(square(F.col(c) - far), square(F.col(c) + 1 + far)) for c in ("cx", "cy")])
    lists = (
        targets.join(known.hint("merge"), squares)
        .where(least("cx", "px") * least("cx", "px") + least("cy", "py") * least("cy", "py") <= F.col("bound"))
        .groupBy(*cell)
        .agg(F.collect_list(F.struct("px", "py")).alias("_points"))
    )

    def squared(p: Column) -> Column:
        dx, dy = F.col("x") - p["px"], F.col("y") - p["py"]
        return dx * dx + dy * dy

    distance = F.when(F.col("det_id").isNotNull(), F.sqrt(F.array_min(F.transform("_points", squared))))
    others = [c for c in spots.columns if c not in (*GRID, "det_id")]
    found = placed.join(lists.hint("merge"), cell, "left").withColumn("distance", distance)
    return found.select(*GRID, "det_id", *others, "distance").withColumn("distance_micron", F.col("distance") * pixel)
