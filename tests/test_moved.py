"""Links and distances: what they move between tasks, and brute force."""

import math
import random

import pytest
from moved import shuffled_rows

from tracklume.operators import graph
from tracklume.operators import grid as G
from tracklume.operators import linking as L

SPOTS = "file string, frame int, det_id long, x double, y double"


def scattered(count, frames, width, height, seed, step=None):
    pick = random.Random(seed)

    def place(size):
        at = pick.uniform(-size / 2, size / 2)
        return at if step is None else round(at / step) * step

    return [(pick.choice("ab"), pick.randrange(frames), i, place(width), place(height)) for i in range(count)]


@pytest.fixture
def no_broadcast(spark):
    """Plans as of tables too large to be sent whole."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_links_move_few_copies(spark, no_broadcast):
    rows = scattered(3000, 200, 2000, 400, 1)
    assert shuffled_rows(L.nearest_partners(spark.createDataFrame(rows, SPOTS))) < 12 * len(rows)  # 38 with a row per frame and square
    assert shuffled_rows(L.mutual_links(spark.createDataFrame(rows, SPOTS))) < 12 * len(rows)


@pytest.mark.parametrize("reach, memory, step", [(20.0, 3, 10.0), (3.0, 0, 1.0), (0.1, 2, 0.1), (7.5, 1, None)])
def test_candidates_by_brute_force(spark, reach, memory, step):
    """Distances of exactly the reach and positions on the borders of blocks included."""
    rows = scattered(300, 12, 12 * reach, 6 * reach, 2, step)
    single = {}
    for file, frame, i, x, y in rows:
        single[file, frame, x, y] = min(i, single.get((file, frame, x, y), i))
    known = [(*k, i) for k, i in single.items()]
    expected = []
    for a in known:
        for b in known:
            gap, distance = b[1] - a[1], math.sqrt((b[2] - a[2]) * (b[2] - a[2]) + (b[3] - a[3]) * (b[3] - a[3]))
            if a[0] == b[0] and 1 <= gap <= memory + 1 and distance <= reach:
                expected.append((a[0], a[4], b[4], gap, distance))
    found = [tuple(r) for r in L._candidates(spark.createDataFrame(rows, SPOTS), reach, memory).collect()]
    assert expected and sorted(found) == sorted(expected)


def test_all_partners_within_reach(spark):
    """Not the nearest alone, and every detection of a position; a row that comes twice is one detection."""
    rows = scattered(300, 12, 240, 120, 5, 10.0)
    expected = []
    for file, frame, i, x, y in rows:
        near = [(b[1] - frame, math.sqrt((b[3] - x) * (b[3] - x) + (b[4] - y) * (b[4] - y)), b[2]) for b in rows if b[0] == file and 1 <= b[1] - frame <= 4]
        expected += [(file, i, b, gap, distance, place) for place, (gap, distance, b) in enumerate(sorted(n for n in near if n[1] <= 20.0), 1)]
    found = [tuple(r) for r in L.nearest_partners(spark.createDataFrame(rows + rows[:50], SPOTS)).collect()]
    assert sorted(found) == sorted(expected) and len(found) > 2 * len({r[:2] for r in found})


def test_lone_nodes_take_no_part_in_rounds(spark, monkeypatch):
    written = []
    keep = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: written.append(df.count()) or keep(df, name))
    nodes = spark.createDataFrame([("f", i) for i in range(500)], "file string, node long")
    edges = spark.createDataFrame([("f", 3, 7), ("f", 7, 11), ("f", 11, 900)], "file string, a long, b long")
    found = [(r.node, r.label) for r in graph.components(nodes, edges, ["file"]).collect()]
    assert sorted(found) == [(i, 3 if i in (3, 7, 11) else i) for i in range(500)]
    assert max(written) <= 6


def test_distances_move_spots_once(spark, no_broadcast):
    pick = random.Random(3)
    rows = [("a", 0, i, pick.uniform(0, 8), pick.uniform(0, 8)) for i in range(5000)]
    points = spark.createDataFrame([("a", 0, x, 3) for x in range(0, 8, 2)], "file string, frame int, x int, y int")
    assert shuffled_rows(G.nearest_distance(spark.createDataFrame(rows, SPOTS), points)) < 5 * len(rows)  # over 60 with a row per square around each spot


@pytest.mark.parametrize("seed", range(4))
def test_distances_by_brute_force(spark, seed):
    pick = random.Random(seed)
    rows = [(pick.choice("abc"), pick.randrange(2), i, pick.uniform(-90, 90), float(pick.randrange(-20, 60))) for i in range(400)]
    points = {(pick.choice("ab"), pick.randrange(2), pick.randrange(-9 - 20 * seed, 9), pick.randrange(-5, 9 + 8 * seed)) for _ in range(8 + 60 * seed)}
    found = G.nearest_distance(spark.createDataFrame(rows, SPOTS), spark.createDataFrame(sorted(points), "file string, frame int, x int, y int"))
    distance = {r.det_id: r.distance for r in found.collect()}
    assert len(distance) == len(rows)
    for file, frame, i, x, y in rows:
        near = [math.sqrt((x - px) * (x - px) + (y - py) * (y - py)) for f, t, px, py in points if (f, t) == (file, frame)]
        assert distance[i] == (min(near) if near else None)
