"""Models under grouped folds: out-of-fold predictions, grids, repeats, single-feature stumps and ridge scores.

The rows of a fold are a filter on the ``fold`` column, so repeats, folds and configurations are data.  Only the fits
themselves are started from the driver, a few at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklume.functions.scalars import ratio
from tracklume.functions.skew import running_totals
from tracklume.operators.panel import melted, scale_for_fold, train_fold_stats
from tracklume.operators.reports import fold_metrics
from tracklume.sources.tables import stored, union_all

MakeEstimator = Callable[[], Estimator]


def with_inputs(estimator: Estimator, features: Sequence[str], principal: Sequence[str] = ()) -> Pipeline:
    """Mean imputation, assembly and a classifier as one estimator, so that everything is fitted inside a fold.

    With ``principal`` columns their principal components (on standardised values) are appended to the features.
    """
    filled = [f"{c}_filled" for c in features]
    stages: list = [Imputer(strategy="mean", inputCols=list(features), outputCols=filled)]
    if principal:
        stages += [
            VectorAssembler(inputCols=filled, outputCol="_own"),
            VectorAssembler(inputCols=[f"{c}_filled" for c in principal], outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
            PCA(k=len(principal), inputCol="_scaled", outputCol="_pca"),
            VectorAssembler(inputCols=["_own", "_pca"], outputCol="features"),
        ]
    else:
        stages.append(VectorAssembler(inputCols=filled, outputCol="features"))
    return Pipeline(stages=[*stages, estimator])


def prepared(df: DataFrame, features: Sequence[str], keys: Sequence[str], label: str, name: str = "model") -> DataFrame:
    """Model input as a stored table with double features: every fit reads it again."""
    columns = [*keys, *[c for c in ("repeat_no", "fold") if c in df.columns and c not in keys]]
    return stored(
        df.select(*columns, F.col(label).cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in features]),
        name,
    )


def fitted_folds(
    df: DataFrame, make: MakeEstimator, features: Sequence[str], k: int = 4, principal: Sequence[str] = (),
    repeats: int = 1, parallelism: int = 4,
) -> dict[tuple[int, int], Model]:
    """One model per (repeat, fold), fitted on the rows outside the fold."""

    @inheritable_thread_target(df.sparkSession)
    def fit(at: tuple[int, int]) -> Model:
        rows = df.where(F.col("repeat_no") == at[0]) if "repeat_no" in df.columns else df
        return with_inputs(make(), features, principal).fit(rows.where(F.col("fold") != at[1]))

    places = [(r, f) for r in range(repeats) for f in range(k)]
    with ThreadPool(min(parallelism, len(places))) as pool:
        return dict(zip(places, pool.map(fit, places)))


def out_of_fold(df: DataFrame, models: Mapping[tuple[int, int], Model], keys: Sequence[str]) -> DataFrame:
    """Prediction of every row by the model that did not see its group."""
    parts = []
    for (repeat, fold), model in models.items():
        rows = df.where(F.col("fold") == fold)
        if "repeat_no" in df.columns:
            rows = rows.where(F.col("repeat_no") == repeat)
        scored = model.transform(rows)
        extra = [c for c in keys if c in scored.columns]
        probability = vector_to_array("probability")
        parts.append(
            scored.select(
                *extra,
                F.lit(repeat).alias("repeat_no"),
                F.lit(fold).alias("fold"),
                F.col("label").alias("truth"),
                F.col("prediction").cast("int").alias("pred"),
                probability[0].alias("proba_0"),
                probability[1].alias("proba_1"),
            )
        )
    return union_all(parts).withColumn("correct", (F.col("truth") == F.col("pred")).cast("int"))


def stump() -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=1, seed=5)


def forest() -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=20, maxDepth=5, seed=5)


def boosted(rounds: int = 10, rate: float = 0.1, depth: int = 3) -> MakeEstimator:
    return lambda: GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=5)


def dense_network(inputs: int, hidden: Sequence[int] = (16, 16), rounds: int = 40) -> MakeEstimator:
    return lambda: MultilayerPerceptronClassifier(layers=[inputs, *hidden, 2], maxIter=rounds, seed=5)


def scaled_folds(df: DataFrame, features: Sequence[str], k: int) -> list[DataFrame]:
    """Per fold the whole table, scaled by the mean and deviation of the rows outside the fold."""
    stats = stored(train_fold_stats(df, features), "scaling")
    return [scale_for_fold(df, features, stats, fold) for fold in range(k)]


def networks_out_of_fold(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], makes: Sequence[MakeEstimator], k: int = 4,
    parallelism: int = 4,
) -> list[DataFrame]:
    """Out-of-fold predictions of several networks on features scaled inside each fold; scaling and imputation are done once for all of them."""
    scaled = scaled_folds(df, features, k)

    @inheritable_thread_target(df.sparkSession)
    def prepare(fold: int) -> tuple[PipelineModel, DataFrame]:
        rows = scaled[fold].where(F.col("fold") != fold)
        inputs = Pipeline(stages=with_inputs(makes[0](), features).getStages()[:-1]).fit(rows)
        # kept as it lies: a network weighs the blocks of rows of each partition
        return inputs, inputs.transform(rows).select("label", "features").persist()

    with ThreadPool(min(parallelism, k)) as pool:
        ready = pool.map(prepare, range(k))

    @inheritable_thread_target(df.sparkSession)
    def run(at: tuple[int, int]) -> DataFrame:
        make, fold = makes[at[0]], at[1]
        inputs, train = ready[fold]
        return out_of_fold(scaled[fold], {(0, fold): PipelineModel([*inputs.stages, make().fit(train)])}, keys)

    places = [(i, fold) for i in range(len(makes)) for fold in range(k)]
    with ThreadPool(min(parallelism, len(places))) as pool:
        parts = pool.map(run, places, 1)
    for _, train in ready:
        train.unpersist()
    return [union_all(parts[i * k : (i + 1) * k]) for i in range(len(makes))]


def network_out_of_fold(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], make: MakeEstimator, k: int = 4,
    parallelism: int = 4,
) -> DataFrame:
    """Out-of-fold predictions of a network on features scaled inside each fold."""
    return networks_out_of_fold(df, features, keys, [make], k, parallelism)[0]


def grid_scores(
    df: DataFrame, features: Sequence[str], rates: Sequence[float], depths: Sequence[int], rounds: int = 5, k: int = 4,
    parallelism: int = 4,
) -> DataFrame:
    """Mean accuracy of boosted trees for every learning rate and depth under the given folds."""
    model = GBTClassifier(maxIter=rounds, seed=5)
    grid = ParamGridBuilder().addGrid(model.stepSize, list(rates)).addGrid(model.maxDepth, list(depths)).build()
    inputs = with_inputs(model, features).getStages()[:-1]
    # Imputation and assembly use no labels; they are refitted with the classifier inside each fold.
    search = CrossValidator(
        estimator=Pipeline(stages=[*inputs, model]),
        estimatorParamMaps=grid,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
        numFolds=k,
        foldCol="fold",
        parallelism=parallelism,
    )
    found = search.fit(df)
    cells = [
        (float(point[model.stepSize]), int(point[model.maxDepth]), float(mean), float(std))
        for point, mean, std in zip(grid, found.avgMetrics, found.stdMetrics)
    ]
    return df.sparkSession.createDataFrame(cells, "rate double, depth int, mean_accuracy double, std_accuracy double")


def knockout_scores(
    df: DataFrame, features: Sequence[str], groups: Mapping[str, Sequence[str]], make: MakeEstimator, k: int = 4,
    parallelism: int = 8,
) -> DataFrame:
    """Accuracy when a feature, or a family of features, is set to zero in training and test, one row for each of both; ``none`` is the full set.

    Missing values are filled once per fold: a mean of zeros is zero.
    """
    single = {c: [c] for c in features}
    if taken := ({"none", *single} & set(groups)):
        raise ValueError(f"families named as a feature: {sorted(taken)}")
    cases = {"none": [], **single, **groups}

    @inheritable_thread_target(df.sparkSession)
    def fill(fold: int) -> PipelineModel:
        return Pipeline(stages=with_inputs(make(), features).getStages()[:1]).fit(df.where(F.col("fold") != fold))

    with ThreadPool(min(parallelism, k)) as pool:
        fills = pool.map(fill, range(k))
    assemble = with_inputs(make(), features).getStages()[1]

    @inheritable_thread_target(df.sparkSession)
    def run(at: tuple[str, int]) -> list[tuple[str, int, float]]:
        name, fold = at
        filled = fills[fold].transform(df).withColumns({f"{c}_filled": F.lit(0.0) for c in cases[name]})
        rows = assemble.transform(filled).select("file", "particle", "fold", "label", "features")
        train = rows.where(F.col("fold") != fold).persist()  # a fit reads it three times before it keeps its own form
        model = make().fit(train)
        train.unpersist()
        scored = out_of_fold(rows, {(0, fold): model}, ["file", "particle"])
        return [(name, r.fold, r.accuracy) for r in fold_metrics(scored, ["fold"]).collect()]  # one row: as one plan the scores of all cases are too large

    places = [(name, fold) for name in cases for fold in range(k)]
    with ThreadPool(min(parallelism, len(places))) as pool:
        parts = [row for found in pool.map(run, places, 1) for row in found]
    found = df.sparkSession.createDataFrame(parts, "knockout string, fold int, accuracy double")
    return found.groupBy("knockout").agg(F.avg("accuracy").alias("accuracy"))


def feature_stumps(df: DataFrame, features: Sequence[str], label: str, k: int) -> DataFrame:
    """Best single threshold per (fold, feature) by Gini impurity, with train and test accuracy.

    All features and folds share one table of class counts per distinct value: its running totals give both sides of
    every possible split.  The threshold lies half way between neighbouring training values, the lowest of equally
    good ones is taken, and each side predicts its larger class (class 0 on a tie).
    """
    own = stored(df.select(label, "fold", *features), "tracks")
    rows = melted(own, [label, "fold"], features).where(F.col("value").isNotNull())
    counts = {
        f"c{c}_{f}": F.when((F.col(label) == c) & (F.col("fold") == f), 1).otherwise(0) for f in range(k) for c in (0, 1)
    }
    # read three times below
    table = stored(running_totals(rows.withColumns(counts), "value", list(counts), ["feature"]), "values")

    def outside(fold: int, c: int, prefix: str):
        return sum((F.col(f"{prefix}c{c}_{f}") for f in range(k) if f != fold), F.lit(0))

    sides = F.array(
        *[
            F.struct(
                F.lit(f).alias("fold"),
                (outside(f, 0, "before_") + outside(f, 0, "")).alias("l0"),
                (outside(f, 1, "before_") + outside(f, 1, "")).alias("l1"),
                (outside(f, 0, "") + outside(f, 1, "")).alias("here"),
                F.col(f"c0_{f}").alias("t0"),
                F.col(f"c1_{f}").alias("t1"),
            )
            for f in range(k)
        ]
    )
    per_fold = table.select("feature", "value", F.inline(sides))
    totals = per_fold.groupBy("feature", "fold").agg(F.max("l0").alias("n0"), F.max("l1").alias("n1"))
    placed = per_fold.join(F.broadcast(totals), ["feature", "fold"])  # one row per feature and fold
    n_left, n_right = F.col("l0") + F.col("l1"), F.col("n0") + F.col("n1") - F.col("l0") - F.col("l1")
    r0, r1 = F.col("n0") - F.col("l0"), F.col("n1") - F.col("l1")
    # in doubles: squares of counts leave the range of long from about 3e9 rows on
    squares = [F.pow(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), F.lit(2.0)) for c in ("l0", "l1", r0, r1)]
    purity = ratio(squares[0] + squares[1], n_left) + ratio(squares[2] + squares[3], n_right)
    splits = placed.where((F.col("here") > 0) & (n_right > 0))
    best = splits.groupBy("feature", "fold").agg(
        F.max_by(
            F.struct("value", "l0", "l1", "n0", "n1"), F.struct(F.round(purity, 9), -F.col("value"))
        ).alias("_b")
    ).select("feature", "fold", F.col("_b.value").alias("low"), "_b.l0", "_b.l1", "_b.n0", "_b.n1")
    chosen = F.broadcast(best)  # one row per feature and fold
    higher = (
        per_fold.where(F.col("here") > 0)
        .select("feature", "fold", "value")
        .join(chosen.select("feature", "fold", "low"), ["feature", "fold"])
        .groupBy("feature", "fold")
        .agg(F.min(F.when(F.col("value") > F.col("low"), F.col("value"))).alias("high"))
    )
    rules = best.join(F.broadcast(higher), ["feature", "fold"]).withColumns(
        {
            "threshold": (F.col("low") + F.col("high")) / 2,
            "left_class": F.when(F.col("l1") > F.col("l0"), 1).otherwise(0),
            "right_class": F.when(r1 > r0, 1).otherwise(0),
        }
    )
    test = (
        per_fold.select("feature", "fold", "value", "t0", "t1")
        .join(F.broadcast(rules.select("feature", "fold", "threshold", "left_class", "right_class")), ["feature", "fold"])
        .withColumn(
            "_class", F.when(F.col("value") <= F.col("threshold"), F.col("left_class")).otherwise(F.col("right_class"))
        )
        .groupBy("feature", "fold")
        .agg(
            F.sum(F.when(F.col("_class") == 1, F.col("t1")).otherwise(F.col("t0"))).alias("_hit"),
            F.sum(F.col("t0") + F.col("t1")).alias("_n"),
        )
    )
    train_hit = F.greatest("l0", "l1") + F.greatest(r0, r1)
    return rules.join(test, ["feature", "fold"]).select(
        "feature",
        "fold",
        "threshold",
        "left_class",
        "right_class",
        ratio(train_hit.cast("double"), F.col("n0") + F.col("n1")).alias("train_accuracy"),
        ratio(F.col("_hit").cast("double"), F.col("_n")).alias("test_accuracy"),
    )


def majority(df: DataFrame, keys: Sequence[str], label: str, name: str) -> DataFrame:
    """Most frequent label per key, the smallest on a tie."""
    counted = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.max_by(label, F.struct(F.col("_n"), -F.col(label))).alias(name))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows per key; Spark keeps only ``k`` rows per key and task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)
