"""Groups above the limit are split, with the same results."""

import pytest
from pyspark.sql import functions as F

from tracklume.functions import skew
from tracklume.operators import features as FT
from tracklume.operators import folds as FO
from tracklume.operators import grid as G
from tracklume.operators import kinematics as K
from tracklume.operators import similarity as SI
from tracklume.operators import stats as ST
from tracklume.plans import inputs as I
from tracklume.plans.series_queries import series


def rows(df, digits=6):
    def tidy(v):
        return round(v, digits) if isinstance(v, float) else v

    return sorted((tuple(tidy(v) for v in r) for r in df.collect()), key=str)


def both(monkeypatch, make):
    monkeypatch.setattr(skew, "HOT_ROWS", 4_000_000)
    monkeypatch.setattr(skew, "BLOCK", 65_536)
    plain = rows(make())
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    monkeypatch.setattr(skew, "BLOCK", 4)
    split = rows(make())
    assert plain == split and plain
    return plain


def test_previous_and_features(spark, small, monkeypatch):
    both(monkeypatch, lambda: FT.track_features(I.observations(spark, small)))


def test_second_differences(spark, small, monkeypatch):
    both(monkeypatch, lambda: K.turning_angles(I.observations(spark, small)))


def test_track_stats(spark, small, monkeypatch):
    both(monkeypatch, lambda: K.step_outliers(I.observations(spark, small)))


def test_folds_of_rows(spark, small, monkeypatch):
    def make():
        data = I.observations(spark, small)
        return FO.with_fold(data.select("file", "particle", "frame"), FO.stratified_group_folds(data), ("frame",))

    both(monkeypatch, make)


def test_fold_ranks(spark, small, monkeypatch):
    data = I.observations(spark, small)
    for balance in ("groups", "rows"):
        both(monkeypatch, lambda b=balance: FO.stratified_group_folds(data, repeats=2, balance=b))
    both(monkeypatch, lambda: FO.group_folds(data))
    both(monkeypatch, lambda: FO.leave_one_group_out(data))


def test_observations(spark, small, monkeypatch):
    both(monkeypatch, lambda: I.derive_observations(spark, small))


def test_rescale_and_threshold(spark, small, monkeypatch):
    events = I.table(spark, small, "events").select("event_id", "event_type", "value")
    both(monkeypatch, lambda: G.above_lower(events, ["event_type"], "value", ["event_id"]))


def test_neighbours(spark, small, monkeypatch):
    both(monkeypatch, lambda: SI.nearest_euclid(series(spark, small), k=3))


def test_percentiles_by_group(spark, small, monkeypatch):
    events = I.table(spark, small, "events").select("event_type", "value")
    got = both(monkeypatch, lambda: ST.percentiles(events, "value", [0.1, 0.5], ["event_type"]))
    exact = events.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5))).alias("p"))
    expected = {(r.event_type, q): r.p[i] for r in exact.collect() for i, q in enumerate((0.1, 0.5))}
    assert {(t, q): v for t, q, v in got} == pytest.approx(expected)


def test_components(spark, small, monkeypatch):
    both(monkeypatch, lambda: G.labelled_cells(I.cells(spark, small)))


def test_gap_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    monkeypatch.setattr(skew, "BLOCK", 4)
    df = spark.createDataFrame([(1, "a", f, float(f)) for f in (0, 1, 2, 40, 41, 90)], "file int, particle string, frame int, v double")
    got = skew.previous(skew.with_blocks(df, ["file", "particle"], "frame"), ["v"], ["file", "particle"], "frame")
    assert [r.prev_v for r in got.orderBy("frame").collect()] == [None, 0.0, 1.0, 2.0, 40.0, 41.0]


@pytest.mark.parametrize("limit", [5, None])
def test_position_matches_a_plain_rank(spark, small, limit):
    from pyspark.sql import Window

    events = I.table(spark, small, "events")
    plain = events.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    split = skew.with_position(events, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "r", limit)
    assert rows(plain.select("event_id", F.col("r").cast("long"))) == rows(split.select("event_id", F.col("r").cast("long")))


def test_running_totals_match_a_plain_window(spark):
    from pyspark.sql import Window

    df = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("v"), F.lit(1).alias("n"))
    got = {r.v: (r.n, r.before_n) for r in skew.running_totals(df, "v", ["n"], pieces=16).collect()}
    merged = df.groupBy("v").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    expected = merged.select("v", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("b")).collect()
    assert got == {r.v: (r.n, r.b) for r in expected}


def test_same_result_under_one_partition(spark, small):
    many = rows(FT.track_features(I.observations(spark, small)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(FT.track_features(I.observations(spark, small))) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
