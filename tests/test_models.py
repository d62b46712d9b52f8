"""Folds, fitted models and attributions: invariants and brute force."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracklume.operators import evaluate as E
from tracklume.operators import explain as X
from tracklume.operators import folds as FO
from tracklume.operators import panel as P
from tracklume.plans import inputs as I
from tracklume.plans.model_queries import model_table
from tracklume.schema import FEATURES, TRACK

SOME = ["MD", "VarD", "MDist", "DistR"]


@pytest.fixture(scope="module")
def table(spark, small):
    return model_table(spark, small)


def test_no_group_in_two_folds(spark, small):
    folds = FO.stratified_group_folds(I.observations(spark, small), repeats=3)
    assert folds.groupBy("repeat_no", "file").count().where("count > 1").count() == 0
    sizes = [r["count"] for r in folds.groupBy("repeat_no", "serum", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_held_out_share(spark, small):
    splits = FO.group_shuffle_splits(I.observations(spark, small), 5)
    shares = splits.groupBy("split").agg(F.sum("is_test").alias("t"), F.count("*").alias("n")).collect()
    assert all(r.t == int(np.ceil(r.n * 0.25)) for r in shares)


def test_scaling_for_a_fold(spark, table):
    stats = P.train_fold_stats(table.select("fold", *SOME), SOME)
    scaled = P.scale_for_fold(table.select("fold", *SOME), SOME, stats, 1).where("fold <> 1")
    got = scaled.agg(*[F.avg(c) for c in SOME], *[F.stddev_pop(c) for c in SOME]).first()
    assert np.allclose(got[:4], 0, atol=1e-9) and np.allclose(got[4:], 1)


def test_every_row_is_predicted_once(table):
    scored = E.out_of_fold(table, E.fitted_folds(table, E.stump, SOME), TRACK)
    assert scored.count() == scored.select(*TRACK).distinct().count() == table.count()
    assert scored.where(F.abs(F.col("proba_0") + F.col("proba_1") - 1) > 1e-9).count() == 0


def test_grid_has_every_cell(table):
    got = E.grid_scores(table, SOME, [0.1, 1.0], [1, 2], rounds=2)
    assert got.count() == 4 and got.where("mean_accuracy BETWEEN 0 AND 1").count() == 4


@pytest.fixture(scope="module")
def explained(table):
    models = E.fitted_folds(table, E.boosted(rounds=3), SOME)
    return models, X.tree_attributions_out_of_fold(table, models, SOME, TRACK).collect(), table


def test_tree_attributions_add_up(explained):
    _, rows, table = explained
    assert len(rows) == table.count()
    for r in rows:
        assert sum(r.phi) == pytest.approx(r.margin - r.base, abs=1e-9)


def test_tree_margin_is_the_models(explained):
    models, rows, table = explained
    from pyspark.ml.functions import vector_to_array

    margins = {}
    for (_, fold), model in models.items():
        scored = model.transform(table.where(F.col("fold") == fold))
        for r in scored.select(*TRACK, vector_to_array("rawPrediction")[1].alias("m")).collect():
            margins[(r.file, r.particle)] = r.m
    for r in rows:
        assert margins[(r.file, r.particle)] == pytest.approx(r.margin)


def test_tree_attributions_match_all_orders(spark, explained):
    models, rows, _ = explained
    leaves = X.leaves_of(spark, models[(0, 0)].stages[-1])

    def value(x, known):
        total = 0.0
        for leaf in leaves:
            part = leaf.value
            for f, a, b, s in zip(leaf.features, leaf.above, leaf.upto, leaf.share):
                part *= float(a < x[f] <= b) if f in known else s
            total += part
        return total

    orders = list(permutations(range(len(SOME))))
    for r in [r for r in rows if r.fold == 0][:3]:
        phi = np.zeros(len(SOME))
        for order in orders:
            for i, f in enumerate(order):
                phi[f] += value(r.x, set(order[: i + 1])) - value(r.x, set(order[:i]))
        assert np.allclose(phi / len(orders), r.phi)


def test_sampled_attributions_add_up(spark, table):
    filled = table.fillna(0.0, SOME)
    model = E.with_inputs(E.stump(), SOME).fit(filled)
    rows = filled.where("fold = 0").select(*TRACK, *SOME)
    phi = X.sampled_attributions(rows, model, SOME, TRACK, filled, orders=3).groupBy(*TRACK).agg(F.sum("phi").alias("s"))
    means = filled.agg(*[F.avg(c).alias(c) for c in SOME])
    from pyspark.ml.functions import vector_to_array

    base = model.transform(means).select(vector_to_array("probability")[1]).first()[0]
    own = model.transform(rows).select(*TRACK, vector_to_array("probability")[1].alias("p"))
    gaps = own.join(phi, TRACK).select(F.max(F.abs(F.col("p") - base - F.col("s")))).first()[0]
    assert gaps < 1e-9


ROWS_ONLY = sorted(set(entry.queries()) - set(entry.oracle_sql()))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_queries_without_twin_run(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_feature_registry():
    assert len(FEATURES) == 20
