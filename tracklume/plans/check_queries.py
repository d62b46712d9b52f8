"""Facts about fitted models that SQL can state: which rows are predicted, probabilities, sums of attributions, variances.

These are checks beside the model queries.  They do not prove the predictions themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.functions.scalars import rounded
from tracklume.operators import series as SE
from tracklume.plans.inputs import table
from tracklume.plans.model_queries import model_table
from tracklume.plans.registry import QUERIES, registered
from tracklume.plans.track_queries import FEATURES_CTE, FOLDS_SQL
from tracklume.schema import FEATURES, PCA_FEATURES, TRACK

_TRACKS = f"{FEATURES_CTE} SELECT * FROM features"


def _predicted(repeats: int) -> str:
    return f"""WITH {FOLDS_SQL}, ft AS ({_TRACKS}) SELECT t.file, t.particle, CAST(f.repeat_no AS INT) AS repeat_no, f.fold, t.serum AS truth,
 CAST(1 AS BIGINT) AS n, true AS proper FROM ft t JOIN folds f ON t.file = f.file WHERE f.repeat_no < {repeats}"""


def predictions(scored: DataFrame) -> DataFrame:
    """Per track, repeat and fold: true class, number of predictions, and whether they are proper (probabilities of sum 1, class of the larger)."""
    sums = F.abs(F.col("proba_0") + F.col("proba_1") - 1) < 1e-5
    sided = (F.col("pred") == (F.col("proba_1") > F.col("proba_0")).cast("int")) | (F.abs(F.col("proba_0") - F.col("proba_1")) < 1e-5)
    marked = F.col("correct") == (F.col("pred") == F.col("truth")).cast("int")
    keys = [*TRACK, "repeat_no", "fold"]
    return scored.groupBy(*keys).agg(F.min("truth").alias("truth"), F.count(F.lit(1)).alias("n"), F.bool_and(sums & sided & marked).alias("proper"))


@registered("gbt_oof_check", _predicted(1))
def gbt_oof_check(spark, sf_dir):
    return predictions(QUERIES["gbt_oof"](spark, sf_dir))


@registered("oof_table_check", _predicted(1))
def oof_table_check(spark, sf_dir):
    return predictions(QUERIES["oof_table"](spark, sf_dir))


@registered("mlp_oof_check", _predicted(1))
def mlp_oof_check(spark, sf_dir):
    return predictions(QUERIES["mlp_oof"](spark, sf_dir))


@registered("imputed_pca_oof_check", _predicted(1))
def imputed_pca_oof_check(spark, sf_dir):
    return predictions(QUERIES["imputed_pca_oof"](spark, sf_dir))


@registered("tree_shap_check", f"""WITH {FOLDS_SQL}, ft AS ({_TRACKS}) SELECT t.file, t.particle, f.fold, CAST({len(FEATURES)} AS BIGINT) AS n,
 true AS adds_up FROM ft t JOIN folds f ON t.file = f.file WHERE f.repeat_no = 0""")
def tree_shap_check(spark, sf_dir):
    """Attributions of a track add up to its margin less the base."""
    phi = QUERIES["tree_shap"](spark, sf_dir)
    gap = F.abs(F.sum("phi") - (F.max("margin") - F.max("base")))
    return phi.groupBy(*TRACK, "fold").agg(F.countDistinct("feature").alias("n"), (gap < 1e-4).alias("adds_up"))


@registered("pca_tracks_check", f"""WITH ft AS ({_TRACKS}), c AS (SELECT * FROM ft WHERE {" AND ".join(f"{c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in PCA_FEATURES)})
 SELECT count(*) AS n, {" + ".join(f"CASE WHEN var_pop({c}) > 0 THEN 1.0 ELSE 0.0 END" for c in PCA_FEATURES)}::DOUBLE AS variance, true AS descending FROM c""")
def pca_tracks_check(spark, sf_dir):
    """The components of standardised columns keep their total variance, in descending shares."""
    scores = SE.principal_components(model_table(spark, sf_dir), PCA_FEATURES, TRACK)
    return rounded(_variances(scores, len(PCA_FEATURES)), 4)


@registered("pca_embeddings_check", """SELECT (SELECT count(*) FROM embeddings) AS n, CAST(count(*) AS DOUBLE) AS variance, true AS descending FROM
 (SELECT d FROM (SELECT generate_subscripts(embedding, 1) AS d, unnest(embedding) AS v FROM embeddings) u GROUP BY d HAVING var_pop(CAST(v AS DOUBLE)) > 0) q""")
def pca_embeddings_check(spark, sf_dir):
    scores = SE.vector_components(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    return rounded(_variances(scores, 64), 4)


def _variances(scores: DataFrame, k: int) -> DataFrame:
    parts = [F.var_pop(f"PC{i}") for i in range(k)]
    falling = [parts[i] >= parts[i + 1] - F.lit(1e-9) for i in range(k - 1)]
    total, ordered = parts[0], falling[0]
    for part in parts[1:]:
        total = total + part
    for step in falling[1:]:
        ordered = ordered & step
    return scores.agg(F.count(F.lit(1)).alias("n"), total.alias("variance"), ordered.alias("descending"))
