"""Queries that fit models under grouped folds; most have no SQL twin and are checked by the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.functions.scalars import rounded
from tracklume.operators import evaluate as E
from tracklume.operators import features as FT
from tracklume.operators import folds as FO
from tracklume.operators import group_ridge as GR
from tracklume.operators import reports as R
from tracklume.plans.inputs import observations
from tracklume.plans.registry import registered, twin
from tracklume.plans.track_queries import FEATURES_CTE, FOLDS_SQL
from tracklume.schema import FEATURE_FAMILIES, FEATURES, PCA_FEATURES, TRACK
from tracklume.sources.tables import labelled, stored, union_all


def model_table(spark: SparkSession, sf_dir: str, repeats: int = 1) -> DataFrame:
    """Features of every track with the fold of its file, stored."""
    rows = observations(spark, sf_dir)
    folds = FO.stratified_group_folds(rows, repeats=repeats)
    if repeats == 1:
        folds = folds.drop("repeat_no")
    tracks = FO.with_fold(FT.track_features(rows), folds, ("particle",))
    return E.prepared(tracks, FEATURES, TRACK, "serum")


@registered("stump_baseline")
def stump_baseline(spark, sf_dir):
    rows = model_table(spark, sf_dir)
    models = E.fitted_folds(rows, E.stump, FEATURES)
    return rounded(R.fold_metrics(E.out_of_fold(rows, models, TRACK), ["fold"]))


@registered("gbt_oof")
def gbt_oof(spark, sf_dir):
    rows = model_table(spark, sf_dir)
    return rounded(E.out_of_fold(rows, E.fitted_folds(rows, E.boosted(), FEATURES), TRACK))


@registered("gbt_grid")
def gbt_grid(spark, sf_dir):
    grid = E.grid_scores(model_table(spark, sf_dir), FEATURES, [0.1, 1.0], [2, 4], rounds=3)
    return rounded(R.score_grid(grid.withColumnRenamed("mean_accuracy", "accuracy"), "rate", "depth", [2, 4]))


@registered("gbt_repeated_cv")
def gbt_repeated_cv(spark, sf_dir):
    rows = model_table(spark, sf_dir, repeats=2)
    models = E.fitted_folds(rows, E.boosted(rounds=3), FEATURES, repeats=2)
    return rounded(R.fold_metrics(E.out_of_fold(rows, models, TRACK), ["repeat_no", "fold"]))


@registered("oof_table")
def oof_table(spark, sf_dir):
    """Features, truth, prediction and probabilities of every track, side by side."""
    rows = model_table(spark, sf_dir)
    models = E.fitted_folds(rows, E.boosted(rounds=5), FEATURES)
    return rounded(E.out_of_fold(rows, models, [*TRACK, *FEATURES]))


@registered("mlp_oof")
def mlp_oof(spark, sf_dir):
    rows = model_table(spark, sf_dir)
    return rounded(E.network_out_of_fold(rows, FEATURES, TRACK, E.dense_network(len(FEATURES))))


@registered("network_curve")
def network_curve(spark, sf_dir):
    """Accuracy of a small network by the number of training rounds, averaged over the folds."""
    rows = model_table(spark, sf_dir)
    curve = (5, 10, 20)
    makes = [E.dense_network(len(FEATURES), hidden=(8,), rounds=rounds) for rounds in curve]
    scored = E.networks_out_of_fold(rows, FEATURES, TRACK, makes)
    parts = [labelled(R.fold_metrics(one, ["repeat_no", "fold"]), epochs=rounds) for rounds, one in zip(curve, scored, strict=True)]
    return rounded(R.score_curve(union_all(parts)))


@registered("imputed_pca_oof")
def imputed_pca_oof(spark, sf_dir):
    rows = model_table(spark, sf_dir)
    models = E.fitted_folds(rows, E.boosted(rounds=5), FEATURES, principal=PCA_FEATURES)
    return rounded(E.out_of_fold(rows, models, TRACK))


@registered("knockout_cv")
def knockout_cv(spark, sf_dir):
    rows = model_table(spark, sf_dir)
    return rounded(E.knockout_scores(rows, FEATURES, FEATURE_FAMILIES, E.boosted(rounds=3)))


_STUMPS_SQL = f"""WITH {FOLDS_SQL}, ft AS ({FEATURES_CTE} SELECT * FROM features),
 rows_ AS (SELECT t.serum, f.fold, {", ".join("t." + c for c in FEATURES)} FROM ft t JOIN folds f ON t.file = f.file WHERE f.repeat_no = 0),
 long AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, fold, serum, {c} AS value FROM rows_ WHERE {c} IS NOT NULL AND NOT isnan({c})" for c in FEATURES)}),
 ks AS (SELECT DISTINCT fold AS k FROM folds),
 vals AS (SELECT feature, k AS fold, value, count(*) FILTER (serum = 0) AS c0, count(*) FILTER (serum = 1) AS c1
  FROM long JOIN ks ON long.fold <> ks.k GROUP BY feature, k, value),
 cum AS (SELECT *, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, sum(c0) OVER p AS n0, sum(c1) OVER p AS n1, lead(value) OVER w AS nextv
  FROM vals WINDOW w AS (PARTITION BY feature, fold ORDER BY value), p AS (PARTITION BY feature, fold)),
 cand AS (SELECT *, round((l0*l0 + l1*l1) / CAST(l0 + l1 AS DOUBLE) + ((n0-l0)*(n0-l0) + (n1-l1)*(n1-l1)) / CAST(n0+n1-l0-l1 AS DOUBLE), 9)
  AS purity FROM cum WHERE nextv IS NOT NULL),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature, fold ORDER BY purity DESC, value) AS rn FROM cand) q WHERE rn = 1),
 rules AS (SELECT feature, fold, (value + nextv) / 2 AS threshold, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS left_class,
  CASE WHEN n1 - l1 > n0 - l0 THEN 1 ELSE 0 END AS right_class, (greatest(l0, l1) + greatest(n0 - l0, n1 - l1)) / CAST(n0 + n1 AS DOUBLE)
  AS train_accuracy FROM best)
 SELECT r.feature, r.fold, threshold, left_class, right_class, max(train_accuracy) AS train_accuracy,
  avg(CASE WHEN (CASE WHEN l.value <= threshold THEN left_class ELSE right_class END) = l.serum THEN 1.0 ELSE 0.0 END) AS test_accuracy
 FROM rules r JOIN long l ON l.feature = r.feature AND l.fold = r.fold GROUP BY ALL"""


@registered(
    "stump_per_feature",
    twin(_STUMPS_SQL, ["feature", "fold", "left_class", "right_class"], ["threshold", "train_accuracy", "test_accuracy"]),
)
def stump_per_feature(spark, sf_dir):
    rows = observations(spark, sf_dir)
    tracks = FO.with_fold(FT.track_features(rows), FO.stratified_group_folds(rows).drop("repeat_no"), ("particle",))
    return rounded(E.feature_stumps(tracks, FEATURES, "serum", 4))


def _left_out(spark: SparkSession, sf_dir: str, features: list[str]) -> DataFrame:
    """Per file the scores of its tracks by ridge weights from all other files."""
    tracks = FT.track_features(observations(spark, sf_dir))
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("vec")
    rows = stored(tracks.select(*TRACK, F.col("serum").alias("label"), vec), "left-out")
    scored = GR.leave_one_group_out_scores(rows, len(features), "file", "particle")
    error = F.pow(F.col("score") - (2 * F.col("truth") - 1), 2)
    hit = (F.col("pred") == F.col("truth")).cast("double")
    return rounded(scored.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg(error).alias("error")))


@registered("logo_ridge")
def logo_ridge(spark, sf_dir):
    return _left_out(spark, sf_dir, FEATURES)


_PAIR = ["MD", "MaxD"]


@registered("logo_ridge_pair", twin(f"""{FEATURES_CTE}, r AS (SELECT file, 2.0 * CAST(serum AS DOUBLE) - 1 AS y,
 coalesce({_PAIR[0]}, 0) - avg(coalesce({_PAIR[0]}, 0)) OVER () AS a, coalesce({_PAIR[1]}, 0) - avg(coalesce({_PAIR[1]}, 0)) OVER () AS b FROM features),
 g AS (SELECT file, CAST(count(*) AS DOUBLE) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab,
  sum(a * y) AS ay, sum(b * y) AS yb FROM r GROUP BY file),
 t AS (SELECT sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(aa) AS aa, sum(bb) AS bb, sum(ab) AS ab, sum(ay) AS ay, sum(yb) AS yb FROM g),
 o AS (SELECT g.file, t.n - g.n AS n, (t.a - g.a) / (t.n - g.n) AS a, (t.b - g.b) / (t.n - g.n) AS b, (t.y - g.y) / (t.n - g.n) AS y,
  t.aa - g.aa AS aa, t.bb - g.bb AS bb, t.ab - g.ab AS ab, t.ay - g.ay AS ay, t.yb - g.yb AS yb FROM g, t WHERE t.n > g.n),
 c AS (SELECT file, a, b, y, sqrt(aa - n * a * a) AS la, sqrt(bb - n * b * b) AS lb, ab - n * a * b AS ab, ay - n * a * y AS ay, yb - n * b * y AS yb FROM o),
 s AS (SELECT *, ab / (la * lb) AS cr, ay / la AS ma, yb / lb AS mb FROM c),
 w AS (SELECT file, a, b, y, (2 * ma - cr * mb) / (4 - cr * cr) / la AS wa, (2 * mb - cr * ma) / (4 - cr * cr) / lb AS wb FROM s),
 p AS (SELECT r.file, r.y AS truth, w.y + w.wa * (r.a - w.a) + w.wb * (r.b - w.b) AS score FROM r JOIN w ON r.file = w.file)
 SELECT file, count(*) AS n, avg(CASE WHEN (score > 0) = (truth > 0) THEN 1.0 ELSE 0.0 END) AS accuracy, avg((score - truth) * (score - truth)) AS error
 FROM p GROUP BY file""", ["file", "n"], ["accuracy", "error"]))
def logo_ridge_pair(spark, sf_dir):
    """As :func:`logo_ridge` on two features, with penalty 1, where SQL can write the solution down."""
    return _left_out(spark, sf_dir, _PAIR)
