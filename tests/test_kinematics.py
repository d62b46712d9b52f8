"""Hand-made tracks with exact answers."""

import math

import pytest
from pyspark.sql import functions as F

from tracklume.functions.scalars import nan_to_null, undirected_angle, wrapped
from tracklume.operators import features as FT
from tracklume.operators import kinematics as K
from tracklume.operators import panel as P
from tracklume.operators import reports as R
from tracklume.operators import select as S
from tracklume.operators import stats as ST

SCHEMA = "file long, particle string, frame int, x_micron double, y_micron double, D double, A double, P double, Dist double, serum int"


def tracks(spark, rows):
    """Rows (file, particle, frame, x, y, Dist) as observations with their step length."""
    base = [(f, p, t, float(x), float(y), None, 100.0, 40.0, d, f % 2) for f, p, t, x, y, d in rows]
    df = spark.createDataFrame(base, SCHEMA)
    steps = K.track_deltas(df)
    return steps.select(*[f.name for f in df.schema.fields])


def one(df, **key):
    for c, v in key.items():
        df = df.where(F.col(c) == v)
    return df.first()


def test_angle_wrap(spark):
    pairs = [(a, b) for a in (-170, -91, -10, 17, 101, 179) for b in (-179, -60, 0, 33, 120, 175)]
    expected = [(b - a + 180) % 360 - 180 for a, b in pairs]
    assert {x - (b - a) for x, (a, b) in zip(expected, pairs)} == {-360, 0, 360}  # both directions, and none
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a int, b int")
    turn = F.degrees(wrapped(F.radians(F.col("b")) - F.radians(F.col("a"))))
    assert [round(r[0]) for r in df.orderBy("i").select(turn).collect()] == expected
    half = spark.createDataFrame([(math.pi,), (-math.pi,)], "d double").select(F.abs(wrapped(F.col("d")))).collect()
    assert [r[0] for r in half] == pytest.approx([math.pi, math.pi])


def test_vertical_steps(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0), (0.0, 0.0), (1.0, 1.0)], "dx double, dy double")
    got = [r[0] for r in df.select(undirected_angle(F.col("dx"), F.col("dy"))).collect()]
    assert got[0] == pytest.approx(math.pi / 2) and got[1] == pytest.approx(-math.pi / 2)
    assert got[2] is None and got[3] == pytest.approx(math.pi / 4)


def test_track_features_of_small_tracks(spark):
    df = tracks(
        spark,
        [
            (1, "one", 0, 5, 5, 1.0),
            (2, "two", 0, 0, 0, 1.0), (2, "two", 1, 3, 4, 2.0),
            (3, "still", 0, 1, 1, 2.0), (3, "still", 1, 1, 1, 2.0), (3, "still", 2, 1, 1, 2.0),
            (4, "a", 0, 0, 0, 1.0), (4, "a", 1, 1, 0, 1.0), (4, "b", 0, 0, 0, 1.0), (4, "b", 1, 0, 1, 1.0),
            (5, "gap", 0, 0, 0, None), (5, "gap", 1, 1, 0, 3.0), (5, "gap", 4, 1, 2, 7.0),
        ],
    )
    got = FT.track_features(df)
    single = one(got, particle="one")
    assert single.MD is None and single.VarD is None and single.sDist is None
    assert single.TD == 0 and single.Pers is None and single.out2sd == 0 and single.ifFast == 0
    pair = one(got, particle="two")
    assert (pair.MD, pair.VarD, pair.TD, pair.Pers) == (5.0, None, 5.0, 1.0)
    still = one(got, particle="still")
    assert still.MD == 0 and still.rVarD is None and still.Pers is None and still.sDist == 0
    assert [one(got, particle=p).ifFast for p in "ab"] == [1, 1]
    assert [one(got, particle=p).ifCentr for p in "ab"] == [1, 1]
    gap = one(got, particle="gap")
    assert gap.TDist == 4.0 and gap.DistR == 4.0 and gap.MD == 1.5


def test_late_start_does_not_leak(spark):
    df = tracks(spark, [(1, "a", 0, 0, 0, 1.0), (1, "a", 1, 1, 1, 1.0), (1, "b", 5, 9, 9, 1.0), (1, "b", 6, 9, 8, 1.0)])
    rows = {(r.particle, r.frame): r.D for r in df.collect()}
    assert rows[("b", 5)] is None and rows[("b", 6)] == 1.0
    assert K.dynamics(df.withColumn("k", F.lit(1))).count() == 0


def test_warm_up_is_dropped_by_position(spark):
    df = tracks(spark, [(1, "b", f, f * f, f, 1.0) for f in (5, 6, 8, 9)])
    assert sorted(r.frame for r in K.dynamics(df).select("frame").collect()) == [8, 9]


def test_missing_comment_is_kept(spark):
    df = spark.createDataFrame(
        [(None, "pl_1398", 0), ("H2B", "pl_1398", 0), ("ok", "pl_1514", 50), ("ok", "other", 0)], "comment string, guide string, time int"
    )
    assert [r.comment for r in S.experiment_filter(df).collect()] == [None]


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, i int"))
    assert df.agg(F.avg("v")).first()[0] == 2.0


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, None)], "a double, b double")
    got = {(r.a, r.b): r.r for r in ST.correlation_matrix(df, ["a", "b"]).collect()}
    assert got[("a", "b")] is None and got[("b", "b")] == pytest.approx(1.0)


def test_no_positive_prediction(spark):
    df = spark.createDataFrame([(0, 1, 0), (0, 0, 0)], "fold int, truth int, pred int")
    got = R.fold_metrics(df, ["fold"]).first()
    assert (got.accuracy, got.precision, got.recall, got.f1) == (0.5, 0.0, 0.0, 0.0)


def test_modal_length_takes_the_shorter_on_a_tie(spark):
    df = spark.createDataFrame([(3,), (3,), (2,), (2,), (2,), (6,)], "nframes int")
    assert P.modal_length(df).first()[0] == 2


def test_exact_percentiles(spark):
    df = spark.range(1, 5).select(F.col("id").cast("double").alias("v"))
    got = {r.q: r.value for r in ST.percentiles(df, "v", [0.25, 0.2, 0.9]).collect()}
    assert got[0.25] == pytest.approx(1.75) and got[0.2] == pytest.approx(1.6) and got[0.9] == pytest.approx(3.7)


def test_spearman_with_ties(spark):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate([(1, 2), (2, 1), (2, 3), (4, 4), (5, 5), (5, 7), (8, 6)])]
    got = ST.spearman(spark.createDataFrame(rows, "k int, a double, b double"), "a", "b", "k").first()
    import pandas as pd

    expected = pd.DataFrame(rows, columns=["k", "a", "b"]).rank()[["a", "b"]].corr().iloc[0, 1]
    assert got.rho == pytest.approx(expected) and 0 < got.p < 0.05


def test_histogram_and_shares(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).alias("c"))
    assert ST.histogram(df, "v", 5).agg(F.sum("n")).first()[0] == 1000
    shares = ST.column_shares(df, "c", F.col("v").cast("int")).groupBy("c").agg(F.sum("share").alias("s"))
    assert all(r.s == pytest.approx(1.0) for r in shares.collect())


def test_one_hot_decodes(spark):
    df = spark.createDataFrame([(0,), (2,), (1,)], "c int")
    coded = P.decoded(P.one_hot(df, "c", [0, 1, 2]), {k: f"c_{k}" for k in range(3)}, "back")
    assert coded.where("c <> back").count() == 0


def test_csv_scan_turns_nan_into_null(spark, tmp_path):
    from tracklume.schema import CANONICAL
    from tracklume.sources.tables import read_observations, rename_canonical, write_csv

    old = spark.createDataFrame([(1, 0, float("nan")), (1, 1, 2.5)], "file long, frame int, diff_xy_micron double")
    place = str(tmp_path / "movie.csv")
    write_csv(old, place)
    back = rename_canonical(read_observations(spark, place, old.schema, "csv"), CANONICAL)
    assert back.columns == ["file", "frame", "D"]
    assert sorted((r.frame, r.D) for r in back.collect()) == [(0, None), (1, 2.5)]


def test_p_value_of_student_t(spark):
    # two-sided tail of Student's t from standard tables
    table = [(2.086, 20.0, 0.05), (2.845, 20.0, 0.01), (1.984, 100.0, 0.05), (2.228, 10.0, 0.05)]
    df = spark.createDataFrame(table, "t double, f double, p double")
    for r in df.select("p", ST.two_sided_p(F.col("t"), F.col("f")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=0.02)


def test_file_name_fields(spark):
    from tracklume.sources.tables import filename_fields

    got = filename_fields(spark.createDataFrame([("20210923_10_a.tif",), ("plain.tif",)], "name string"), "name").collect()
    assert (got[0].date, got[0].serum, got[0].file) == ("20210923", 10, "20210923_10_a")
    assert (got[1].serum, got[1].file) == (None, "plain")
