"""Queries that explain predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklume.functions.scalars import rounded
from tracklume.operators import attribution as AT
from tracklume.operators import evaluate as E
from tracklume.operators import explain as X
from tracklume.operators import features as FT
from tracklume.plans.inputs import observations
from tracklume.plans.model_queries import model_table
from tracklume.plans.registry import registered, twin
from tracklume.plans.track_queries import FEATURES_CTE
from tracklume.schema import FEATURES, TRACK
from tracklume.sources.tables import stored, union_all


@registered("tree_shap")
def tree_shap(spark, sf_dir):
    rows = model_table(spark, sf_dir)
    models = E.fitted_folds(rows, E.boosted(rounds=5), FEATURES)
    explained = X.tree_attributions_out_of_fold(rows, models, FEATURES, TRACK)
    return rounded(X.long_form(explained, FEATURES, [*TRACK, "fold", "base", "margin"]))


@registered("shap_averaged")
def shap_averaged(spark, sf_dir):
    """Attributions and values per track averaged over the repeats of the folds."""
    rows = model_table(spark, sf_dir, repeats=2)
    models = E.fitted_folds(rows, E.boosted(rounds=3), FEATURES, repeats=2)
    explained = X.tree_attributions_out_of_fold(rows, models, FEATURES, TRACK)
    return rounded(AT.averaged(X.long_form(explained, FEATURES, [*TRACK, "repeat_no"]), TRACK, FEATURES))


_SAMPLED = ["MD", "VarD", "MDist", "Pers", "DistR"]


@registered("sampled_shap")
def sampled_shap(spark, sf_dir):
    """Sampled attributions of a network for the tracks of every fold, by the network that did not see them."""
    rows = model_table(spark, sf_dir).fillna(0.0, _SAMPLED)
    parts = []
    for fold, table in enumerate(E.scaled_folds(rows, _SAMPLED, 4)):
        scaled = stored(table, "scaled")
        train = scaled.where(F.col("fold") != fold)
        model = E.with_inputs(E.dense_network(len(_SAMPLED), hidden=(8,), rounds=20)(), _SAMPLED).fit(train)
        test = scaled.where(F.col("fold") == fold).select(*TRACK, *_SAMPLED)
        parts.append(X.sampled_attributions(test, model, _SAMPLED, TRACK, train))
    return rounded(union_all(parts))


@registered("linear_shap", twin(f"""WITH f AS ({FEATURES_CTE} SELECT * FROM features),
 s AS (SELECT var_pop(MA) AS saa, var_pop(MDist) AS sbb, covar_pop(MA, MDist) AS sab, covar_pop(MA, serum) AS say,
 covar_pop(MDist, serum) AS sby, avg(MA) AS ma_, avg(MDist) AS mb_ FROM f),
 w AS (SELECT (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb, ma_, mb_ FROM s)
 SELECT file, particle, 'MA' AS feature, wa * (MA - ma_) AS phi, MA AS value FROM f, w UNION ALL
 SELECT file, particle, 'MDist', wb * (MDist - mb_), MDist FROM f, w""", ["file", "particle", "feature"], ["phi", "value"]))
def linear_shap(spark, sf_dir):
    tracks = FT.track_table(observations(spark, sf_dir)).select(*TRACK, "serum", "MA", "MDist")
    fit = X.two_feature_fit(tracks, "serum", "MA", "MDist")
    return rounded(X.linear_attributions(tracks, TRACK, fit, {"MA": ("_wa", "_ma"), "MDist": ("_wb", "_mb")}))
