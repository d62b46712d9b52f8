"""Work that several fits share is done once, and small tables with much work are spread."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracklume.operators import evaluate as E
from tracklume.operators.reports import fold_metrics
from tracklume.plans import series_queries

FEATURES = ["f", "g"]


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(4)
    made = []
    for i in range(160):
        label = pick.randrange(2)
        made.append((i // 4, str(i % 4), i % 4, label, None if i % 9 == 0 else label + pick.gauss(0, 0.7), None if i % 7 == 0 else pick.gauss(0, 1)))
    df = spark.createDataFrame(made, "file long, particle string, fold int, serum int, f double, g double")
    return E.prepared(df, FEATURES, ["file", "particle"], "serum")


@pytest.fixture
def imputations(monkeypatch):
    done = []

    class Counted(E.Imputer):
        def _fit(self, dataset):
            done.append(1)
            return super()._fit(dataset)

    monkeypatch.setattr(E, "Imputer", Counted)
    return done


def test_knockouts_share_the_filling_of_missing_values(rows, imputations):
    families = {"first": ["f"], "second": ["g"]}
    make = E.boosted(rounds=2)
    found = {r.knockout: r.accuracy for r in E.knockout_scores(rows, FEATURES, families, make).collect()}
    assert len(imputations) == 4
    for name, gone in {"none": [], **families}.items():
        zeroed = rows.withColumns({c: F.lit(0.0) for c in gone})
        scored = E.out_of_fold(zeroed, E.fitted_folds(zeroed, make, FEATURES), ["file", "particle"])
        assert found[name] == pytest.approx(fold_metrics(scored, ["fold"]).agg(F.avg("accuracy")).first()[0], abs=1e-12)


def test_every_feature_is_knocked_out(rows):
    make = E.boosted(rounds=2)
    found = {r.knockout: r.accuracy for r in E.knockout_scores(rows, FEATURES, {"both": FEATURES}, make).collect()}
    assert set(found) == {"none", "f", "g", "both"}
    for name in FEATURES:
        zeroed = rows.withColumn(name, F.lit(0.0))
        scored = E.out_of_fold(zeroed, E.fitted_folds(zeroed, make, FEATURES), ["file", "particle"])
        assert found[name] == pytest.approx(fold_metrics(scored, ["fold"]).agg(F.avg("accuracy")).first()[0], abs=1e-12)
    with pytest.raises(ValueError):
        E.knockout_scores(rows, FEATURES, {"f": ["g"]}, make)


def test_networks_share_scaling_and_filling(rows, imputations, monkeypatch):
    scalings, scaled = [], E.scaled_folds
    monkeypatch.setattr(E, "scaled_folds", lambda *a: scalings.append(1) or scaled(*a))
    makes = [E.dense_network(2, hidden=(3,), rounds=n) for n in (2, 5)]
    found = E.networks_out_of_fold(rows, FEATURES, ["file", "particle"], makes)
    assert len(imputations) == 4 and len(scalings) == 1 and len(found) == 2
    for make, scored in zip(makes, found):
        given = {(r.file, r.particle): (r.truth, r.pred, r.proba_1) for r in scored.collect()}
        assert len(given) == 160
        for fold, table in enumerate(scaled(rows, FEATURES, 4)):
            model = E.with_inputs(make(), FEATURES).fit(table.where(F.col("fold") != fold))
            for r in E.out_of_fold(table, {(0, fold): model}, ["file", "particle"]).collect():
                assert given[r.file, r.particle] == (r.truth, r.pred, pytest.approx(r.proba_1, abs=1e-9))


def test_kernels_are_spread_over_tasks(spark, tmp_path, monkeypatch):
    pick, start = random.Random(5), datetime.datetime(2024, 1, 1)
    events = [(u * 20 + i, start + datetime.timedelta(minutes=u + 90 * i), u, "view", pick.uniform(0, 100), f'{{"k": {pick.randrange(100)}}}') for u in range(40) for i in range(12)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    parts, features = [], series_queries.SE.kernel_features
    monkeypatch.setattr(series_queries.SE, "kernel_features", lambda df, *a: parts.append(df.rdd.getNumPartitions()) or features(df, *a))
    monkeypatch.setattr(series_queries, "ROCKET_ROWS", 4, raising=False)
    assert series_queries.rocket_ridge(spark, str(tmp_path), count=3).count() > 0
    assert parts == [10]


def test_sweep_of_the_panel_is_planned_in_steps(spark, tmp_path, monkeypatch):
    pick, start = random.Random(6), datetime.datetime(2024, 1, 1)
    events = [(u * 20 + i, start + datetime.timedelta(minutes=u + 90 * i), u, "view", pick.uniform(0, 100), f'{{"k": {pick.randrange(100)}}}') for u in range(24) for i in range(7)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    plans, store = [], series_queries.stored
    monkeypatch.setattr(series_queries, "stored", lambda df, name: plans.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or store(df, name))
    assert series_queries.panel_sweep(spark, str(tmp_path)).count() == 160
    assert max(plans) < 200_000


def test_sweep_of_the_panel_keeps_one_row_per_track(spark, tmp_path, monkeypatch):
    """What is written and searched does not grow with the feature sets and repeats."""
    pick, start = random.Random(7), datetime.datetime(2024, 1, 1)
    events = [(u * 20 + i, start + datetime.timedelta(minutes=u + 90 * i), u, "view", pick.uniform(0, 100), f'{{"k": {pick.randrange(100)}}}') for u in range(24) for i in range(7)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    written, store = [], series_queries.stored
    for module in (series_queries, series_queries.SI):
        monkeypatch.setattr(module, "stored", lambda df, name: ("vec" in df.columns and written.append(df.count())) or store(df, name))
    assert series_queries.panel_sweep(spark, str(tmp_path)).count() == 160
    assert written == [24, 24, 24]
