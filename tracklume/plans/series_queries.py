"""Queries on series: neighbours, random kernels, interval features and principal components."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.functions.scalars import rounded
from tracklume.operators import evaluate as E
from tracklume.operators import folds as FO
from tracklume.operators import kinematics as K
from tracklume.operators import panel as P
from tracklume.operators import reports as R
from tracklume.operators import ridge as RI
from tracklume.operators import series as SE
from tracklume.operators import similarity as SI
from tracklume.operators import stats as ST
from tracklume.operators import wide_ridge as WR
from tracklume.plans.inputs import observations, table
from tracklume.plans.model_queries import model_table
from tracklume.plans.registry import registered, twin
from tracklume.plans.track_queries import FOLDS_SQL, LENGTHS_SQL, MODAL_SQL, STEPS_SQL, WITH_TRACKS
from tracklume.schema import FEATURE_SETS, PCA_FEATURES, TRACK
from tracklume.sources.tables import stored


def series(spark: SparkSession, sf_dir: str, value: str = "Dist") -> DataFrame:
    """Series of the tracks of modal length, with class and the fold of their file."""
    rows = observations(spark, sf_dir)
    panel = P.modal_tracks(rows.select(*TRACK, "frame", value, "serum_conc_percent"))
    nested = P.nested(panel, [value]).select(
        F.col("fp").alias("id"), F.col("group").alias("file"), F.col("class").alias("label"), F.col(value).alias("vec")
    )
    folded = FO.with_fold(nested, FO.stratified_group_folds(rows).drop("repeat_no"), ("id",)).drop("file")
    return stored(folded, "series")  # the searches read it several times


_SERIES_SQL = f"""WITH {FOLDS_SQL}, m AS ({MODAL_SQL} SELECT * FROM modal), s AS (SELECT CAST(m.file AS VARCHAR) || '__' || particle AS id,
 CAST(trunc(max(serum_conc_percent) / 10) AS INT) AS label, list(Dist ORDER BY frame) AS vec, max(f.fold) AS fold
 FROM m JOIN folds f ON m.file = f.file WHERE f.repeat_no = 0 GROUP BY m.file, particle),
 pairs AS (SELECT a.id, a.fold, a.label, b.id AS neighbour, b.label AS neighbour_label, list_distance(a.vec, b.vec) AS distance
 FROM s a JOIN s b ON a.fold <> b.fold),
 near AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INT) AS place FROM pairs)"""


@registered("knn_neighbours", twin(f"{_SERIES_SQL} SELECT * FROM near WHERE place <= 5",
                                   ["id", "fold", "label", "place", "neighbour", "neighbour_label"], ["distance"]))
def knn_neighbours(spark, sf_dir):
    return rounded(SI.nearest_euclid(series(spark, sf_dir)))


@registered("knn_series", twin(f"""{_SERIES_SQL} SELECT id, fold, label AS truth, mode_ AS pred FROM (SELECT id, fold, label,
 neighbour_label AS mode_, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, neighbour_label) AS rn FROM near
 WHERE place <= 5 GROUP BY id, fold, label, neighbour_label) v WHERE rn = 1""", ["id", "fold", "truth", "pred"], []))
def knn_series(spark, sf_dir):
    return SI.voted(SI.nearest_euclid(series(spark, sf_dir)))


CHANNELS = ("D", "A", "Dist")


def channel_columns(spark: SparkSession, sf_dir: str, values: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Series of the tracks of modal length, an array per channel, with class and the fold of their file; a missing step counts as 0."""
    rows = observations(spark, sf_dir)
    panel = P.modal_tracks(rows.select(*TRACK, "frame", *values, "serum_conc_percent"))
    filled = [F.transform(v, lambda x: F.coalesce(x, F.lit(0.0))).alias(v) for v in values]
    nested = P.nested(panel, list(values)).select(
        F.col("fp").alias("id"), F.col("group").alias("file"), F.col("class").alias("label"), *filled
    )
    return FO.with_fold(nested, FO.stratified_group_folds(rows).drop("repeat_no"), ("id",)).drop("file")


def channel_series(spark: SparkSession, sf_dir: str, values: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Series of several channels of the tracks of modal length: the channels one after the other in one array.

    The Euclidean distance of such arrays is that of the multi-channel series.
    """
    return stored(channel_columns(spark, sf_dir, values).select("id", "label", F.concat(*values).alias("vec"), "fold"), "series")


_CHANNEL_SQL = _SERIES_SQL.replace("list(Dist ORDER BY frame) AS vec", " || ".join(f"list(coalesce({c}, 0.0) ORDER BY frame)" for c in CHANNELS) + " AS vec")


@registered("knn_channels", twin(f"""{_CHANNEL_SQL} SELECT id, fold, label AS truth, mode_ AS pred FROM (SELECT id, fold, label,
 neighbour_label AS mode_, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, neighbour_label) AS rn FROM near
 WHERE place <= 5 GROUP BY id, fold, label, neighbour_label) v WHERE rn = 1""", ["id", "fold", "truth", "pred"], []))
def knn_channels(spark, sf_dir):
    """Neighbours of series of three channels."""
    return SI.voted(SI.nearest_euclid(channel_series(spark, sf_dir)))


# One step of the recurrence per round: cell (i, j) of the cost table from the last m + 1 cells, row by row.
_DTW_SQL = _SERIES_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "list(Dist ORDER BY frame) AS vec", ", ".join(f"list(coalesce({c}, 0.0) ORDER BY frame) AS {c}" for c in CHANNELS)
).split(" pairs AS (")[0] + f""" c AS (SELECT a.id, a.fold, a.label, b.id AS neighbour, b.label AS neighbour_label, len(a.D) AS m, {", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in CHANNELS)}
  FROM s a JOIN s b ON a.fold <> b.fold),
 step AS (SELECT id, neighbour, m, CAST(0 AS BIGINT) AS t, list_transform(range(m + 1), lambda x: CAST('inf' AS DOUBLE)) AS last FROM c
  UNION ALL SELECT s.id, s.neighbour, s.m, t + 1, list_append(last[2:], {" + ".join(f"abs(a_{c}[t // s.m + 1] - b_{c}[t % s.m + 1])" for c in CHANNELS)}
   + CASE WHEN t = 0 THEN 0.0 ELSE least(CASE WHEN t % s.m > 0 THEN last[s.m + 1] ELSE CAST('inf' AS DOUBLE) END, last[2],
     CASE WHEN t % s.m > 0 THEN last[1] ELSE CAST('inf' AS DOUBLE) END) END)
  FROM step s JOIN c ON s.id = c.id AND s.neighbour = c.neighbour WHERE t < s.m * s.m),
 found AS (SELECT c.id, c.fold, c.label, c.neighbour, c.neighbour_label, last[c.m + 1] AS distance FROM step JOIN c ON step.id = c.id AND step.neighbour = c.neighbour WHERE t = c.m * c.m),
 near AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INT) AS place FROM found)"""


@registered("dtw_pairs", twin(f"{_DTW_SQL} SELECT * FROM near WHERE place <= 5", ["id", "fold", "label", "place", "neighbour", "neighbour_label"], ["distance"]))
def dtw_pairs(spark, sf_dir):
    """Neighbours under warping of three channels."""
    return rounded(SI.nearest_warped(channel_series(spark, sf_dir), channels=len(CHANNELS)))


@registered("knn_dtw", twin(f"""{_DTW_SQL}, votes AS (SELECT id, fold, label AS truth, neighbour_label AS pred, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, neighbour_label) AS rn
 FROM near WHERE place <= 5 GROUP BY id, fold, label, neighbour_label),
 n AS (SELECT fold, count(*) FILTER (truth = 1 AND pred = 1) AS tp, count(*) FILTER (truth = 0 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred = 0) AS fn,
  count(*) FILTER (truth = 0 AND pred = 0) AS tn FROM votes WHERE rn = 1 GROUP BY fold)
 SELECT fold, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM n""", ["fold"], ["accuracy", "precision", "recall", "f1"]))  # fmt: skip
def knn_dtw(spark, sf_dir):
    found = SI.nearest_warped(channel_series(spark, sf_dir), channels=len(CHANNELS))
    return rounded(R.fold_metrics(SI.voted(found), ["fold"]))


@registered("knn_manhattan", twin(f"""{_CHANNEL_SQL.replace("list_distance(a.vec, b.vec)", "list_sum(list_transform(range(1, len(a.vec) + 1), lambda i: abs(a.vec[i] - b.vec[i])))")}
 SELECT * FROM near WHERE place <= 5""", ["id", "fold", "label", "place", "neighbour", "neighbour_label"], ["distance"]))
def knn_manhattan(spark, sf_dir):
    """Neighbours under a metric given by the caller."""
    return rounded(SI.nearest_by(channel_series(spark, sf_dir), SI.manhattan))


def kernel_table(spark: SparkSession, sf_dir: str, count: int = 40) -> DataFrame:
    """Random kernel features of the series; the kernels depend on the length of the series only."""
    rows = series(spark, sf_dir)
    length = rows.agg(F.max(F.size("vec"))).first()[0]
    kernels = SE.random_kernels(count, length)
    return SE.kernel_features(rows.withColumnRenamed("vec", "series"), ["series"], kernels)


@registered("rocket_features")
def rocket_features(spark, sf_dir):
    rows = kernel_table(spark, sf_dir)
    return rounded(rows.select("id", "fold", "label", F.posexplode("vec").alias("position", "value")))


def _stated_kernels() -> list[SE.Kernel]:
    """Four kernels that do not depend on the data: one, two and three channels, with and without dilation and padding."""

    def weights(channels: int, size: int) -> np.ndarray:
        grid = np.add.outer(np.arange(channels) * 3, np.arange(size) * 5) % 7 - 2.5
        return grid - grid.mean(axis=1, keepdims=True)

    shapes = [((0,), 7, 0.1, 1, 0), ((0, 2), 7, -0.2, 2, 6), ((0, 1, 2), 9, 0.0, 1, 4), ((1,), 3, 0.3, 4, 4)]
    return [SE.Kernel(weights(len(c), n), np.asarray(c), bias, dilation, padding) for c, n, bias, dilation, padding in shapes]


_KERNELS = _stated_kernels()
_TAPS_SQL = " UNION ALL ".join(
    f"SELECT {k} AS kernel, '{CHANNELS[c]}' AS channel, {j * kernel.dilation - kernel.padding} AS shift, {float(kernel.weights[i, j])!r}::DOUBLE AS weight"
    for k, kernel in enumerate(_KERNELS) for i, c in enumerate(kernel.channels) for j in range(kernel.weights.shape[1])
)
_SHAPES_SQL = " UNION ALL ".join(
    f"SELECT {k} AS kernel, {kernel.bias!r}::DOUBLE AS bias, {2 * kernel.padding - (kernel.weights.shape[1] - 1) * kernel.dilation} AS longer" for k, kernel in enumerate(_KERNELS)
)
_LONG_SQL = " UNION ALL ".join(
    f"SELECT CAST(file AS VARCHAR) || '__' || particle AS id, '{c}' AS channel, coalesce({c}, 0.0) AS v, row_number() OVER (PARTITION BY file, particle ORDER BY frame) - 1 AS t FROM m" for c in CHANNELS
)


@registered("rocket_kernels", twin(f"""WITH m AS ({MODAL_SQL} SELECT * FROM modal), rows AS ({_LONG_SQL}),
 z AS (SELECT id, channel, t, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w = 0 THEN 1 ELSE stddev_pop(v) OVER w END AS z FROM rows WINDOW w AS (PARTITION BY id, channel)),
 taps AS ({_TAPS_SQL}), shapes AS ({_SHAPES_SQL}), lengths AS (SELECT id, max(t) + 1 AS n FROM z GROUP BY id),
 grid AS (SELECT id, kernel, bias, unnest(range(n + longer)) AS t FROM lengths, shapes),
 response AS (SELECT g.id, g.kernel, g.t, g.bias + coalesce(sum(weight * z), 0) AS r FROM grid g JOIN taps USING (kernel)
  LEFT JOIN z ON z.id = g.id AND z.channel = taps.channel AND z.t = g.t + shift GROUP BY g.id, g.kernel, g.t, g.bias)
 SELECT id, CAST(kernel AS INT) AS kernel, max(r) AS largest, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM response GROUP BY id, kernel""",
                              ["id", "kernel"], ["largest", "positive"]))
def rocket_kernels(spark, sf_dir):
    """Responses of four stated kernels on three channels."""
    found = SE.kernel_features(channel_columns(spark, sf_dir), CHANNELS, _KERNELS)
    places = F.array(*[F.struct(F.lit(k).alias("kernel"), F.get("vec", F.lit(2 * k)).alias("largest"), F.get("vec", F.lit(2 * k + 1)).alias("positive")) for k in range(len(_KERNELS))])
    return rounded(found.select("id", F.inline(places)))


ROCKET_ROWS = 64  # series of one task


@registered("rocket_ridge")
def rocket_ridge(spark, sf_dir, count: int = 10_000):
    """Out-of-fold scores of 10,000 random kernels (20,000 columns) on all channels."""
    rows = stored(channel_columns(spark, sf_dir), "channels")
    facts = rows.agg(F.max(F.size(CHANNELS[0])).alias("length"), F.count(F.lit(1)).alias("n")).first()
    if facts.length is None:
        kernels = []
    else:
        kernels = SE.random_kernels(count, facts.length, len(CHANNELS))
    # a stated number of partitions: small data, much work
    dealt = rows.repartition(max(1, math.ceil(facts.n / ROCKET_ROWS)))
    features = stored(SE.kernel_features(dealt, CHANNELS, kernels), "kernels")
    return rounded(R.fold_metrics(WR.out_of_fold(features), ["fold", "penalty"]))


_SWEEP = ["dxy", "angle", "dangle", "darea", "dperimeter", "x", "y", "min_dist_pxs", "area_micron", "perimeter_au"]


@registered("fset_sweep")
def fset_sweep(spark, sf_dir):
    """Grouped scores of all twenty feature sets on one table of per-track means and deviations."""
    rows = observations(spark, sf_dir)
    names = {"x_micron": "x", "y_micron": "y", "Dist": "min_dist_pxs", "A": "area_micron", "P": "perimeter_au"}
    steps = K.dynamics(rows).withColumnsRenamed(names)
    values = [f(c) for c in _SWEEP for f in (F.avg, F.stddev_samp)]
    tracks = steps.groupBy(*TRACK).agg(
        F.max("serum").alias("label"), F.array(*[F.coalesce(v, F.lit(0.0)) for v in values]).alias("vec")
    )
    folds = FO.stratified_group_folds(rows).drop("repeat_no")
    folded = stored(FO.with_fold(tracks, folds, ("particle",)), "sweep")
    places = {
        name: [2 * _SWEEP.index(c) + i for c in members for i in (0, 1)] for name, members in FEATURE_SETS.items()
    }
    scored = RI.ridge_out_of_fold(folded, 2 * len(_SWEEP), places)
    per_fold = R.fold_metrics(scored, ["set", "fold"])
    return rounded(per_fold.groupBy(F.col("set").alias("fset")).agg(
        F.avg("accuracy").alias("accuracy"), F.stddev_samp("accuracy").alias("std"), F.avg("f1").alias("f1")
    ))


_STEP_NAMES = {"x_micron": "x", "y_micron": "y", "Dist": "min_dist_pxs", "A": "area_micron", "P": "perimeter_au"}
_STEP_SQL = {new: old for old, new in _STEP_NAMES.items()} | {"dxy": "sqrt(dx * dx + dy * dy)"}
_SETS_SQL = " UNION ALL ".join(
    f"SELECT id, file, label, '{name}' AS fset, {' || '.join(members)} AS vec FROM arrays" for name, members in FEATURE_SETS.items()
)


@registered("panel_sweep", twin(f"""{STEPS_SQL}, steps_ AS (SELECT file, particle, frame, serum_conc_percent, {", ".join(f"{_STEP_SQL.get(c, c)} AS {c}" for c in _SWEEP)}
  FROM turns WHERE pos > 2), sized AS (SELECT *, count(frame) OVER (PARTITION BY file, particle) AS nframes FROM steps_),
 best AS (SELECT nframes FROM sized GROUP BY nframes ORDER BY count(*) DESC, nframes LIMIT 1),
 scaled AS (SELECT file, particle, frame, serum_conc_percent, {", ".join(f"coalesce(({c} - avg({c}) OVER t) / nullif(stddev_pop({c}) OVER t, 0), 0.0) AS {c}" for c in _SWEEP)}
  FROM sized JOIN best ON sized.nframes = best.nframes WINDOW t AS (PARTITION BY file, particle)),
 arrays AS (SELECT CAST(file AS VARCHAR) || '__' || particle AS id, file, CAST(trunc(max(serum_conc_percent) / 10) AS INT) AS label,
  {", ".join(f"list({c} ORDER BY frame) AS {c}" for c in _SWEEP)} FROM scaled GROUP BY file, particle), sets AS ({_SETS_SQL}), {FOLDS_SQL.replace(WITH_TRACKS, "")},
 s AS (SELECT sets.*, folds.fold, folds.repeat_no FROM sets JOIN folds ON sets.file = folds.file),
 pairs AS (SELECT a.fset, a.repeat_no, a.id, a.fold, a.label, b.id AS neighbour, b.label AS neighbour_label, list_distance(a.vec, b.vec) AS distance
  FROM s a JOIN s b ON a.fset = b.fset AND a.repeat_no = b.repeat_no AND a.fold <> b.fold),
 near AS (SELECT *, row_number() OVER (PARTITION BY fset, repeat_no, id ORDER BY distance, neighbour) AS place FROM pairs),
 votes AS (SELECT fset, repeat_no, id, fold, label AS truth, neighbour_label AS pred, row_number() OVER (PARTITION BY fset, repeat_no, id ORDER BY count(*) DESC, neighbour_label) AS rn
  FROM near WHERE place <= 5 GROUP BY fset, repeat_no, id, fold, label, neighbour_label),
 n AS (SELECT fset, repeat_no, fold, count(*) FILTER (truth = 1 AND pred = 1) AS tp, count(*) FILTER (truth = 0 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred = 0) AS fn,
  count(*) FILTER (truth = 0 AND pred = 0) AS tn FROM votes WHERE rn = 1 GROUP BY fset, repeat_no, fold)
 SELECT fset, repeat_no, fold, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM n""", ["fset", "repeat_no", "fold"], ["accuracy", "precision", "recall", "f1"]))  # fmt: skip
def panel_sweep(spark, sf_dir):
    """Scores of a neighbour classifier on the step series of every feature set, in every repeat and fold: one search for all sets and repeats.

    A channel is scaled within its series; the distance of a set is that of its channels together.  Every step reads its input several times, so its
    result is a written table: as one plan they are thousands of operators, and planning them takes longer than running them.
    """
    rows = observations(spark, sf_dir)
    steps = stored(K.dynamics(rows).withColumnsRenamed(_STEP_NAMES).select(*TRACK, "frame", "serum_conc_percent", *_SWEEP), "steps")
    scaled = P.scale_by_series(stored(P.modal_tracks(steps), "modal"), _SWEEP)
    filled = stored(scaled.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in _SWEEP}), "scaled")
    nested = stored(P.nested(filled, _SWEEP), "nested")
    folds = stored(FO.stratified_group_folds(rows, repeats=2), "folds")
    track = nested.select(F.col("fp").alias("id"), F.col("group").alias("file"), F.col("class").alias("label"), F.concat(*_SWEEP).alias("vec"))
    samples = stored(FO.with_fold(track, FO.in_one_row(folds), ("id",)).drop("file"), "samples")
    sets = {name: [_SWEEP.index(c) for c in members] for name, members in FEATURE_SETS.items()}
    found = SI.nearest_in_sets(samples, sets, len(_SWEEP))
    by = ["fset", "repeat_no"]
    return rounded(R.fold_metrics(SI.voted(found, by), [*by, "fold"]))


_INTERVAL_SQL = f"""{LENGTHS_SQL}, spans AS (SELECT file, particle, min(frame) AS f0, max(frame) AS f1 FROM tracks GROUP BY file, particle)
 SELECT t.file, t.particle, CAST((frame - f0) * 3 // (f1 - f0 + 1) AS INT) AS interval_no, count(*) AS n, avg(Dist) AS Dist_mean,
 stddev_samp(Dist) AS Dist_std, regr_slope(Dist, frame) AS Dist_slope, avg(D) AS D_mean, stddev_samp(D) AS D_std,
 regr_slope(D, frame) AS D_slope FROM tracks t JOIN spans s ON t.file = s.file AND t.particle = s.particle GROUP BY 1, 2, 3"""


@registered("interval_features", twin(_INTERVAL_SQL, ["file", "particle", "interval_no", "n"],
                                      [f"{c}_{s}" for c in ("Dist", "D") for s in ("mean", "std", "slope")]))
def interval_features(spark, sf_dir):
    rows = observations(spark, sf_dir).select(*TRACK, "frame", "Dist", "D")
    return rounded(SE.interval_features(rows, ["Dist", "D"]).withColumnRenamed("interval", "interval_no"))


@registered("interval_forest")
def interval_forest(spark, sf_dir):
    rows = observations(spark, sf_dir)
    wide = SE.intervals_wide(SE.interval_features(rows, ["Dist", "D"]))
    labels = rows.groupBy(*TRACK).agg(F.max("serum").alias("serum"))
    features = [c for c in wide.columns if c not in TRACK]
    folds = FO.stratified_group_folds(rows).drop("repeat_no")
    folded = FO.with_fold(wide.join(labels, TRACK), folds, ("particle",))
    table_ = E.prepared(folded, features, TRACK, "serum")
    models = E.fitted_folds(table_, E.forest, features)
    return rounded(E.out_of_fold(table_, models, TRACK))


@registered("pca_tracks")
def pca_tracks(spark, sf_dir):
    rows = model_table(spark, sf_dir)
    scores = SE.principal_components(rows, PCA_FEATURES, [*TRACK, "label"])
    return rounded(scores.select(*TRACK, "label", *[F.abs(f"PC{i}").alias(f"PC{i}") for i in range(len(PCA_FEATURES))]))


@registered("pca_embeddings")
def pca_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    scores = SE.vector_components(rows, "embedding", ["vec_id", "label"])
    return rounded(scores.select("vec_id", "label", *[F.abs(f"PC{i}").alias(f"PC{i}") for i in range(64)]))


@registered("density_2d", twin(f"""WITH p AS ({LENGTHS_SQL} SELECT serum, avg(Dist) AS u, avg(A) AS v FROM tracks GROUP BY file, particle, serum),
 e AS (SELECT min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM p),
 g AS (SELECT serum, count(*) AS n, stddev_samp(u) * pow(count(*), -1.0 / 6) AS hu, stddev_samp(v) * pow(count(*), -1.0 / 6) AS hv FROM p GROUP BY serum),
 k AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM range(10) a(i), range(10) b(j))
 SELECT p.serum, k.i, k.j, sum(exp(-(pow((u - (u0 + (u1 - u0) * k.i / 9)) / hu, 2) + pow((v - (v0 + (v1 - v0) * k.j / 9)) / hv, 2)) / 2)
 / (2 * pi() * hu * hv * n)) * 1000 AS density FROM p JOIN g ON p.serum = g.serum, e, k GROUP BY p.serum, k.i, k.j""",
                               ["serum", "i", "j"], ["density"]))
def density_2d(spark, sf_dir):
    tracks = observations(spark, sf_dir).groupBy(*TRACK, "serum").agg(F.avg("Dist").alias("u"), F.avg("A").alias("v"))
    return rounded(ST.density_2d(tracks, "u", "v", "serum").withColumn("density", F.col("density") * 1000))


def _weight_sql(value: str) -> str:
    from tracklume.operators.stats import POISSON_1

    return " + ".join(f"CASE WHEN {value} >= {p!r} THEN 1 ELSE 0 END" for p in POISSON_1)


@registered("mean_diff_ci", twin(f"""WITH p AS ({LENGTHS_SQL} SELECT file, particle, CASE WHEN time = 0 THEN 'before' ELSE 'after' END AS condition,
 avg(Dist) AS v FROM tracks WHERE time < 40 GROUP BY file, particle, time),
 u AS (SELECT p.*, r.replicate, CAST('0x' || substring(md5('11|' || CAST(r.replicate AS VARCHAR) || '|' || CAST(file AS VARCHAR) || '|' || particle), 1, 8)
 AS BIGINT) / 4294967296.0 AS h FROM p, range(1, 201) r(replicate)),
 w AS (SELECT *, {_weight_sql("CAST(h AS DOUBLE)")} AS w FROM u),
 m AS (SELECT replicate, condition, sum(w * v) / nullif(sum(w), 0) AS m FROM w GROUP BY replicate, condition),
 d AS (SELECT replicate, max(m) FILTER (condition = 'after') - max(m) FILTER (condition = 'before') AS d FROM m GROUP BY replicate)
 SELECT (SELECT avg(v) FROM p WHERE condition = 'after') - (SELECT avg(v) FROM p WHERE condition = 'before') AS difference,
 (SELECT count(*) FROM p WHERE condition = 'before') AS n_before, (SELECT count(*) FROM p WHERE condition = 'after') AS n_after,
 quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM d""", ["n_before", "n_after"], ["difference", "low", "high"]))
def mean_diff_ci(spark, sf_dir):
    tracks = observations(spark, sf_dir).groupBy(*TRACK, "time").agg(F.avg("Dist").alias("MDist"))
    return rounded(ST.mean_difference(ST.before_after(tracks, "MDist"), "MDist", TRACK))
