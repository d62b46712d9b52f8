"""Results do not depend on where a track begins, how far apart things are, or how large a number is."""

import math

import pytest
from pyspark.sql import functions as F

from tracklume.functions.scalars import rounded
from tracklume.operators import grid, panel, stats
from tracklume.operators.graph import components
from tracklume.sources.tables import read_observations, read_recursive_csv, write_csv

OBSERVED = "file string, particle int, frame int, D double, serum_conc_percent double"


def track(spark, frames):
    return spark.createDataFrame([("a", 1, f, float(f), 10.0) for f in frames], OBSERVED)


def test_a_short_track_is_one_series_wherever_it_begins(spark):
    found = panel.nested(track(spark, range(65526, 65554)), ["D"]).collect()
    assert [(r.chunk, r.length, r["class"], r.group) for r in found] == [(0, 28, 1, "a")]
    assert found[0].D == [float(f) for f in range(65526, 65554)]


def test_pieces_of_a_long_track_carry_the_facts_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(panel, "SERIES_FRAMES", 10)
    found = sorted(panel.nested(track(spark, range(5, 30)), ["D"]).collect(), key=lambda r: r.chunk)
    assert [(r.chunk, r.length, len(r.D)) for r in found] == [(0, 25, 10), (1, 25, 10), (2, 25, 5)]


def test_wide_tables_hold_every_frame(spark):
    rows = track(spark, [0, 3, 99])
    assert panel.frames_of(rows) == [0, 3, 99]
    wide = panel.wide_by_frame(rows, ["D"], panel.frames_of(rows)).first()
    assert (wide.D_0, wide.D_3, wide.D_99) == (0.0, 3.0, 99.0)


def test_a_distant_point_has_its_distance(spark):
    spots = spark.createDataFrame([("a", 0, 1, 1000.0, 0.0), ("a", 0, 2, 0.0, 3.0), ("b", 0, 3, 0.0, 0.0)], "file string, frame int, det_id int, x double, y double")
    points = spark.createDataFrame([("a", 0, 0, 0)], "file string, frame int, x int, y int")
    found = {r.det_id: r.distance for r in grid.nearest_distance(spots, points).collect()}
    assert found == {1: 1000.0, 2: 3.0, 3: None}


def test_large_doubles_are_not_cut(spark):
    values = [1e14, -3e20, 1.25, math.inf, math.nan, None, 4503599627.5]
    found = rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")).orderBy("i").collect()
    assert [r.v for r in found] == [1e14, -3e20, 1.25, None, None, None, 4503599627.5]


@pytest.mark.parametrize("cells", [[(-1, 1), (16777215, 0)], [(-1, 0), (2**31 - 1, -1)], [(-(2**31), 5), (2**31 - 1, 4)]])
def test_cells_far_apart_are_two_components(spark, cells):
    df = spark.createDataFrame([("a", 0, x, y) for x, y in cells], "file string, frame int, x int, y int")
    assert [r["size"] for r in grid.labelled_cells(df).collect()] == [1, 1]


def test_a_long_chain_is_one_component(spark):
    nodes = spark.range(600).select(F.lit("a").alias("file"), F.col("id").alias("node"))
    edges = spark.range(599).select(F.lit("a").alias("file"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in components(nodes, edges, ["file"]).collect()} == {0}


def test_every_set_is_written_and_csv_folders_are_read(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 1.5), ("s9", math.nan), ("x", 3.0)], "fset string, v double")
    write_csv(rows.withColumn("dir", F.col("fset")), str(tmp_path / "sets"), ["dir"])
    assert sorted(r.dir for r in read_recursive_csv(spark, str(tmp_path / "sets"), rows.schema).collect()) == ["dir=s1", "dir=s9", "dir=x"]
    write_csv(rows, str(tmp_path / "plain"))
    assert sorted((r.v for r in read_observations(spark, str(tmp_path / "plain"), rows.schema, "csv").collect()), key=str) == [1.5, 3.0, None]


def test_otsu_with_many_bins_matches_all_pairs(spark):
    values = [float(v) for v in [*range(0, 30), *range(100, 120), *range(300, 340)]]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    found = grid.otsu_limits(df, ["k"], "v", bins=200).first()
    assert 29 <= found.lower < 100 and 119 <= found.upper < 300


def test_weights_reach_the_resolution_of_the_hash():
    assert 1 - stats.POISSON_1[-1] <= 2.0**-32 < 1 - stats.POISSON_1[-2]
    assert abs(stats.POISSON_1[1] - 2 / math.e) < 1e-12


def test_blocks_of_frames_have_one_schema(spark):
    rows = track(spark, [0, 3, 31, 32, 65526]).unionByName(track(spark, [5]).withColumn("frame", F.lit(None).cast("int")))
    found = {r.first_frame: r.D for r in panel.wide_blocks(rows, ["D"], without=[("D", 0)]).collect()}
    assert set(found) == {0, 32, 65504} and all(len(d) == 32 for d in found.values())
    assert {f + i: v for f, d in found.items() for i, v in enumerate(d) if v is not None} == {f: float(f) for f in (3, 31, 32, 65526)}


def test_p_values_of_students_t():
    # closed forms: 1 and 2 degrees of freedom; and the finite series for more
    assert abs(stats.student_p(1.0, 1) - 0.5) < 1e-14
    assert abs(stats.student_p(2.0, 2) - (1 - 2 / math.sqrt(6))) < 1e-14
    for n in range(4, 40):
        v = n - 2
        for t in (0.01, 0.662122, 1.7, 12.0):
            cos2 = v / (v + t * t)
            sine = t / math.sqrt(v + t * t)
            total, term = 0.0, (math.sqrt(cos2) if v % 2 else 1.0)
            for k in range(1 + v % 2, v, 2):
                total += term
                term *= cos2 * k / (k + 1)
            inside = sine * total if v % 2 == 0 else 2 / math.pi * (math.atan(t / math.sqrt(v)) + sine * total)
            assert abs(stats.student_p(t, v) - (1 - inside)) < 1e-12, (n, t)
    assert abs(stats.student_p(1.959963984540054, 1e8) - 0.05) < 1e-8
