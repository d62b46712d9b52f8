"""Joint links against all assignments."""

import itertools

import numpy as np
import pytest

from tracklume.operators import graph
from tracklume.operators import joint_linking as J
from tracklume.operators import linking as L

SCHEMA = "file string, frame int, det_id long, x double, y double"


def every_assignment(costs, skip):
    """Least total over all ways to give rows different columns or none."""
    best = (float("inf"), None)
    for picks in itertools.product(*[[None, *row] for row in costs]):
        taken = [j for j in picks if j is not None]
        if len(set(taken)) == len(taken):
            total = sum(skip if j is None else row[j] for row, j in zip(costs, picks))
            best = min(best, (total, picks), key=lambda b: b[0])
    return best


def brute_links(rows, reach, memory):
    links, live = set(), {}
    for frame in sorted({r[1] for r in rows}):
        live = {a: at for a, at in live.items() if frame - at[2] <= memory + 1}
        new = {r[2]: (r[3], r[4]) for r in rows if r[1] == frame}
        costs = [{d: (x - at[0]) ** 2 + (y - at[1]) ** 2 for d, (x, y) in new.items() if (x - at[0]) ** 2 + (y - at[1]) ** 2 <= reach**2} for at in live.values()]
        for a, d in zip(list(live), every_assignment(costs, reach**2)[1]):
            if d is not None:
                links.add((a, d))
                del live[a]
        live.update({d: (x, y, frame) for d, (x, y) in new.items()})
    return links


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_is_the_least_of_all(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(0, 6, 2)
    costs = [{int(j): float(rng.integers(0, 12) if seed % 2 else rng.random() * 12) for j in range(m) if rng.random() < 0.6} for _ in range(n)]
    got = J.cheapest(costs, 8.0)
    taken = [j for j in got if j is not None]
    assert len(set(taken)) == len(taken)
    total = sum(8.0 if j is None else row[j] for row, j in zip(costs, got))
    assert total == pytest.approx(every_assignment(costs, 8.0)[0])


def test_long_chain_moves_on_by_one():
    """Each row prefers the column of the row before; only all of them together are cheapest."""
    n = 400
    costs = [{i: 1.0, i + 1: 1.5} for i in reversed(range(n))] + [{0: 0.1}]
    assert J.cheapest(costs, 1000.0) == [i + 1 for i in reversed(range(n))] + [0]


def test_crossing_that_mutual_nearest_misses(spark):
    rows = [("m", 0, 0, 0.0, 0.0), ("m", 0, 1, 10.0, 0.0), ("m", 1, 2, 8.0, 0.0), ("m", 1, 3, 19.0, 0.0)]
    rows += [("n", 0, 0, 0.0, 0.0), ("n", 1, 2, None, 0.0), ("n", 2, 3, float("nan"), 0.0), ("n", 4, 4, 1.0, 1.0), ("n", 9, 5, 1.0, 1.0), (None, 1, 7, 0.0, 0.0)]
    spots = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in L.mutual_links(spots.where("file = 'm'"), 15.0).collect()} == {("m", 1, 2)}
    assert {tuple(r) for r in J.joint_links(spots, 15.0).collect()} == {("m", 0, 2), ("m", 1, 3), ("n", 0, 4)}
    tracks = {(r.file, r.det_id): r.track for r in J.joint_tracks(spots.where("file is not null"), 15.0).collect()}
    assert tracks == {("m", 0): 0, ("m", 2): 0, ("m", 1): 1, ("m", 3): 1, ("n", 0): 0, ("n", 4): 0, ("n", 2): 2, ("n", 3): 3, ("n", 5): 5}
    assert J.joint_links(spots.where("frame > 99")).count() == 0


@pytest.mark.parametrize("limit", [J.JOINT_ROWS, 0])
def test_links_are_those_of_all_assignments(spark, limit):
    """``limit`` 0 solves every component frame by frame."""
    rng = np.random.default_rng(5)
    rows = [(file, f, 10 * f + i, float(x), float(y)) for file in ("p", "q") for f in (0, 1, 3, 4) for i, (x, y) in enumerate(rng.uniform(0, 40, (4, 2)))]
    rows += [("p", f, 100 + 10 * f + i, 500.0 + float(x), 0.0) for f in (0, 3, 4) for i, x in enumerate(rng.uniform(0, 30, 3))]
    got = {tuple(r) for r in J.joint_links(spark.createDataFrame(rows, SCHEMA), 16.0, 2, limit).collect()}
    assert got == {(file, *pair) for file in ("p", "q") for pair in brute_links([r for r in rows if r[0] == file], 16.0, 2)}


def test_tables_that_grow_with_the_detections_are_not_sent_to_the_driver(spark, monkeypatch):
    """Files of ids are many times smaller than the tables in memory, so their size must not decide on a broadcast."""
    plans = []
    keep = graph.stored

    def seen(df, name):
        if name == "labels":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(graph, "stored", seen)
    nodes = keep(spark.range(6).selectExpr("'f' AS file", "id AS node"), "nodes")
    edges = keep(spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 4, 5)], "file string, a long, b long"), "edges")
    found = {r.node: r.label for r in graph.components(nodes, edges, ["file"]).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    # the keys of labels shared by very many nodes are the only broadcast
    assert any("SortMergeJoin" in p for p in plans) and all(p.count("BroadcastHashJoin") == p.count("as int) AS _ways") for p in plans)
    spots = keep(spark.createDataFrame([("f", 0, 1, 2.0, 3.0), ("f", 1, 2, 2.0, 3.0)], SCHEMA), "spots")
    tracks = J.joint_tracks(spots)
    assert {tuple(r) for r in tracks.select("det_id", "track").collect()} == {(1, 1), (2, 1)}
    assert "BroadcastHashJoin" not in tracks._jdf.queryExecution().optimizedPlan().toString() + tracks._jdf.queryExecution().executedPlan().toString()
