"""Cells, distances and links against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklume.operators import grid as G
from tracklume.operators import linking as L


def random_cells(spark, share=0.55, size=12, seed=3):
    rng = np.random.default_rng(seed)
    masks = {f: rng.random((size, size)) < share for f in range(3)}
    rows = [("m", f, int(x), int(y)) for f, mask in masks.items() for x, y in zip(*np.nonzero(mask))]
    return masks, spark.createDataFrame(rows, "file string, frame int, x int, y int")


def parts_of(mask):
    seen, out = set(), {}
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        stack, part = [start], set()
        while stack:
            x, y = stack.pop()
            if (x, y) in part or not (0 <= x < mask.shape[0] and 0 <= y < mask.shape[1]) or not mask[x, y]:
                continue
            part.add((x, y))
            stack += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
        seen |= part
        for cell in part:
            out[cell] = len(part)
    return out


@pytest.mark.parametrize("tile", [1024, 5])
def test_component_sizes(spark, tile):
    masks, cells = random_cells(spark)
    rows = G.labelled_cells(cells, tile).collect()
    got = {(r.frame, r.x, r.y): r.size for r in rows}
    assert {r.label for r in rows if r.frame == 0} <= {y * 2**24 + x for x in range(12) for y in range(12)}
    first = {}
    for r in rows:
        place = r.y * 2**24 + r.x
        first[(r.frame, r.label)] = min(first.get((r.frame, r.label), place), place)
    assert all(label == place for (_, label), place in first.items())
    expected = {(f, int(x), int(y)): n for f, mask in masks.items() for (x, y), n in parts_of(mask).items()}
    assert got == expected


def test_holes_are_filled(spark):
    ring = [("m", 0, x, y) for x in range(5) for y in range(5) if (x, y) != (2, 2)]
    cells = spark.createDataFrame(ring, "file string, frame int, x int, y int")
    assert G.without_holes(cells, 2, 5, 5).count() == 25
    assert G.without_holes(cells, 1, 5, 5).count() == 24


def test_boundary(spark):
    full = [("m", 0, x, y) for x in range(7) for y in range(7)]
    cells = spark.createDataFrame(full, "file string, frame int, x int, y int")
    assert len(G.disk(3)) == 29
    assert G.boundary(cells, 1).count() == 24
    assert G.boundary(cells, 1, (7, 7)).count() == 0


@pytest.mark.parametrize("extent", [64])
def test_nearest_distance(spark, extent):
    rng = np.random.default_rng(8)
    points = {(f, int(x), int(y)) for f in range(3) for x, y in rng.integers(0, 40, size=(6, 2))}
    spots = [("m", f, i, float(x), float(y)) for i, (f, x, y) in enumerate(zip(rng.integers(0, 4, 60), *rng.uniform(0, 40, (2, 60))))]
    spots = [(m, int(f), i, x, y) for m, f, i, x, y in spots]
    got = G.nearest_distance(
        spark.createDataFrame(spots, "file string, frame int, det_id int, x double, y double"),
        spark.createDataFrame([("m", *p) for p in points], "file string, frame int, x int, y int"),
        extent,
    ).collect()
    assert len(got) == 60
    for r in got:
        own = [np.hypot(r.x - x, r.y - y) for f, x, y in points if f == r.frame]
        assert (r.distance == pytest.approx(min(own))) if own else (r.distance is None)


def test_links_survive_gaps_and_copies(spark):
    rows = [("m", f, 10 * f, 5.0 * f, 0.0) for f in (0, 1, 2, 5, 6)]  # two frames missing
    rows += [("m", f, 10 * f + 1, 100.0, 50.0) for f in range(7)] + [("m", 3, 999, 100.0, 50.0)]
    rows += [("m", 12, 120, 30.0, 0.0)]  # too late for a link
    got = L.linked_tracks(spark.createDataFrame(rows, "file string, frame int, det_id long, x double, y double"))
    tracks = {}
    for r in got.collect():
        tracks.setdefault(r.track, set()).add(r.det_id)
    assert tracks[0] == {0, 10, 20, 50, 60}
    assert tracks[1] == {10 * f + 1 for f in range(7)}
    assert tracks[999] == {999} and tracks[120] == {120}
    assert L.without_stubs(got, 6).select("track").distinct().count() == 1


def test_long_path_is_one_component(spark):
    from tracklume.operators.graph import components

    nodes = spark.range(300).select(F.lit(1).alias("g"), F.col("id").alias("node"))
    edges = spark.range(299).select(F.lit(1).alias("g"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(nodes, edges, ["g"]).select("label").distinct().collect()[0][0] == 0
