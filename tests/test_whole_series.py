"""A track is one series, however many frames it has."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklume.operators import panel
from tracklume.plans import series_queries as S

FRAMES = 65_540  # more than the 65,536 frames after which tracks were cut


def test_a_long_track_is_one_series(spark):
    rows = spark.range(FRAMES).select(F.lit("a").alias("file"), F.lit(1).alias("particle"), F.col("id").cast("int").alias("frame"), F.col("id").cast("double").alias("D"), F.lit(10.0).alias("serum_conc_percent"))
    found = panel.nested(rows, ["D"]).collect()
    assert [(r.fp, r.chunk, r.length) for r in found] == [("a__1", 0, FRAMES)]
    assert found[0].D == [float(i) for i in range(FRAMES)]


@pytest.fixture(scope="module")
def long_tracks(spark, tmp_path_factory):
    """Events of eight users, one type: a value and a number in the text."""
    folder = tmp_path_factory.mktemp("long")
    rows = spark.range(8 * FRAMES).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.floor(F.col("id") / 8)).alias("ts"),
        (F.col("id") % 8).alias("user_id"),
        F.lit("view").alias("event_type"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("value"),
        F.concat(F.lit('{"k": '), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).cast("string"), F.lit("}")).alias("props"),
    )
    rows.write.parquet(str(folder / "events.parquet"))
    x, y = np.empty((8, FRAMES)), np.empty((8, FRAMES))
    for r in rows.toPandas().itertuples():
        x[r.user_id, r.event_id // 8], y[r.user_id, r.event_id // 8] = r.value, int(r.props[6:-1])
    step = np.hypot(np.diff(x, prepend=np.nan), np.diff(y, prepend=np.nan))
    step[:, 0] = 0.0
    return str(folder), {"Dist": np.abs(x - y) / 10, "D": step, "A": 100 + x}


def expected(found, distance):
    fold = {r.id: r.fold for r in found}
    assert sorted(fold) == [f"{u}__view" for u in range(8)] and len(set(fold.values())) > 1
    out = set()
    for name in fold:
        near = sorted((distance(int(name[0]), int(other[0])), other) for other in fold if fold[other] != fold[name])
        out |= {(name, place, other, round(d, 3)) for place, (d, other) in enumerate(near[:5], 1)}
    return out


def listed(found):
    return {(r.id, r.place, r.neighbour, round(r.distance, 3)) for r in found}


def test_manhattan_neighbours_of_long_tracks(spark, long_tracks):
    folder, values = long_tracks
    found = S.knn_manhattan(spark, folder).collect()
    assert listed(found) == expected(found, lambda i, j: sum(float(np.abs(values[c][i] - values[c][j]).sum()) for c in S.CHANNELS))


def test_euclidean_neighbours_of_long_tracks(spark, long_tracks):
    folder, values = long_tracks
    found = S.knn_neighbours(spark, folder).collect()
    assert listed(found) == expected(found, lambda i, j: float(np.linalg.norm(values["Dist"][i] - values["Dist"][j])))


def test_votes_on_long_tracks(spark, long_tracks):
    folder, values = long_tracks
    found = {r.id: r for r in S.knn_series(spark, folder).collect()}
    near = expected(found.values(), lambda i, j: float(np.linalg.norm(values["Dist"][i] - values["Dist"][j])))
    for name, row in found.items():
        votes = [int(other[0]) % 2 for i, _, other, _ in near if i == name]
        assert row.truth == int(name[0]) % 2 and row.pred == int(2 * sum(votes) > len(votes))
    assert {r.id for r in S.series(spark, folder).select("id").collect()} == set(found)
