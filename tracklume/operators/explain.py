"""Attributions of predictions: exact for trees and linear models, sampled for any other model."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklume.functions.scalars import ratio
from tracklume.sources.tables import new_location, union_all


@dataclass(frozen=True)
class Leaf:
    """A leaf with, per feature on its path, the interval it demands and the share of training rows that meet it."""

    value: float
    features: tuple[int, ...]
    above: tuple[float, ...]
    upto: tuple[float, ...]
    share: tuple[float, ...]


def leaves_of(spark: SparkSession, model: Model) -> list[Leaf]:
    """Leaves of a fitted boosted-tree model, read from its saved node table (a few rows per tree)."""
    place = new_location(spark, "trees")
    model.save(place)
    nodes: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{place}/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(row["treeID"], {})[row["id"]] = row
    out = []
    for tree, weight in enumerate(model.treeWeights):
        table = nodes[tree]
        open_paths = [(0, {})]
        while open_paths:
            at, path = open_paths.pop()
            node = table[at]
            if node["leftChild"] < 0:
                found = sorted(path.items())
                out.append(
                    Leaf(
                        weight * node["prediction"],
                        tuple(f for f, _ in found),
                        tuple(p[0] for _, p in found),
                        tuple(p[1] for _, p in found),
                        tuple(p[2] for _, p in found),
                    )
                )
                continue
            feature, limit = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node["leftChild"], (low, min(high, limit))), (node["rightChild"], (max(low, limit), high))):
                kept = table[child]["rawCount"] / node["rawCount"]
                open_paths.append((child, {**path, feature: (*bounds, share * kept)}))
    return out


def leaf_attributions(x: np.ndarray, leaf: Leaf) -> np.ndarray:
    """Shapley values of one leaf on a batch: rows x features on its path.

    A feature inside a coalition passes the rows that meet its interval, one outside passes its share of the training
    rows.  The sum over coalitions is taken size by size with a polynomial in the size.
    """
    m = len(leaf.features)
    inside = np.stack(
        [(x[:, f] > a) & (x[:, f] <= b) for f, a, b in zip(leaf.features, leaf.above, leaf.upto)], axis=1
    ).astype(float)
    weights = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    out = np.empty((len(x), m))
    for i in range(m):
        by_size = np.zeros((len(x), m))
        by_size[:, 0] = 1.0
        for j in range(m):
            if j != i:
                shifted = np.zeros_like(by_size)
                shifted[:, 1:] = by_size[:, :-1] * inside[:, [j]]
                by_size = by_size * leaf.share[j] + shifted
        out[:, i] = leaf.value * (inside[:, i] - leaf.share[i]) * (by_size @ weights)
    return out


def tree_attributions(df: DataFrame, model: Model, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Exact path-dependent Shapley values of a boosted-tree model: ``base``, ``margin`` and an array ``phi`` per row.

    ``df`` carries the assembled ``features``.  The values are on the raw margin and add up to ``margin - base``.
    """
    leaves = leaves_of(df.sparkSession, model)
    base = float(sum(leaf.value * np.prod(leaf.share) for leaf in leaves))
    kept = df.select(*keys, vector_to_array("features").alias("x"))
    schema = T.StructType(
        [
            *kept.schema.fields,
            T.StructField("base", T.DoubleType()),
            T.StructField("margin", T.DoubleType()),
            T.StructField("phi", T.ArrayType(T.DoubleType())),
        ]
    )
    width = len(names)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["x"].to_numpy()).astype(float)
            phi, margin = np.zeros((len(x), width)), np.zeros(len(x))
            for leaf in leaves:
                if leaf.features:
                    phi[:, list(leaf.features)] += leaf_attributions(x, leaf)
                hit = np.ones(len(x), dtype=bool)
                for f, a, b in zip(leaf.features, leaf.above, leaf.upto):
                    hit &= (x[:, f] > a) & (x[:, f] <= b)
                margin[hit] += leaf.value
            yield batch.assign(base=base, margin=margin, phi=list(phi))

    return kept.mapInPandas(explain, schema)


def long_form(df: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per (keys, feature) with attribution and value."""
    listed = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("phi"), F.col("x").alias("value"))
    return df.select(*keys, F.inline(listed)).toDF(*keys, "feature", "phi", "value")


def tree_attributions_out_of_fold(
    df: DataFrame, models: Mapping[tuple[int, int], Model], names: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Attributions of every row by the model that did not see its group, wide in ``phi``."""
    parts = []
    for (repeat, fold), model in models.items():
        rows = df.where(F.col("fold") == fold)
        if "repeat_no" in df.columns:
            rows = rows.where(F.col("repeat_no") == repeat)
        inputs = rows
        for stage in model.stages[:-1]:
            inputs = stage.transform(inputs)
        explained = tree_attributions(inputs, model.stages[-1], names, keys)
        parts.append(explained.withColumns({"repeat_no": F.lit(repeat), "fold": F.lit(fold)}))
    return union_all(parts)


def sampled_attributions(
    df: DataFrame, model: Model, features: Sequence[str], keys: Sequence[str], background: DataFrame, orders: int = 4,
    seed: int = 13,
) -> DataFrame:
    """Shapley values of any fitted classifier from random feature orders, against the mean of ``background``.

    Along an order the features switch from the mean to their own value one after the other; the change of the
    probability at a switch is credited to the feature.  All rows, orders and switches are scored as one table.
    """
    p = len(features)
    rng = np.random.default_rng(seed)
    drawn = [rng.permutation(p).tolist() for _ in range(orders)]
    means = background.agg(*[F.avg(c).alias(f"_mean_{c}") for c in features]).withColumn("_one", F.lit(1))
    # (order, step): features switched on, the one that was switched last, and the one that comes next
    steps = [
        (o, s, [int(f in order[:s]) for f in range(p)], order[s - 1] if s else -1, order[s] if s < p else -1)
        for o, order in enumerate(drawn)
        for s in range(p + 1)
    ]
    plan = df.sparkSession.createDataFrame(
        [(1, [(on, last, following) for _, _, on, last, following in steps])],
        "_one int, _plan array<struct<on: array<int>, last: int, following: int>>",
    )
    exploded = (
        df.withColumn("_one", F.lit(1))
        .join(F.broadcast(means), "_one")
        .join(F.broadcast(plan), "_one")  # one row: orders x (features + 1) entries
        .select(
            *keys, *features, *[f"_mean_{c}" for c in features], F.inline("_plan")
        )
    )
    mixed = exploded.select(
        *keys,
        "last",
        "following",
        *[F.when(F.col("on")[i] == 1, F.col(c)).otherwise(F.col(f"_mean_{c}")).alias(c) for i, c in enumerate(features)],
    )
    score = vector_to_array("probability")[1]
    credit = F.array(
        F.struct(F.col("last").alias("i"), score.alias("v")), F.struct(F.col("following").alias("i"), (-score).alias("v"))
    )
    names = F.array(*[F.lit(c) for c in features])
    return (
        model.transform(mixed)
        .select(*keys, F.inline(credit))
        .where(F.col("i") >= 0)
        .groupBy(*keys, names[F.col("i")].alias("feature"))
        .agg((F.sum("v") / orders).alias("phi"))
    )


def two_feature_fit(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Least squares plane of ``y`` on two columns: one row of weights and means."""
    saa, sbb, sab = F.var_pop(a), F.var_pop(b), F.covar_pop(a, b)
    say, sby = F.covar_pop(a, y), F.covar_pop(b, y)
    det = saa * sbb - sab * sab
    return df.agg(
        ratio(say * sbb - sby * sab, det).alias("_wa"),
        ratio(sby * saa - say * sab, det).alias("_wb"),
        F.avg(a).alias("_ma"),
        F.avg(b).alias("_mb"),
    )


def linear_attributions(df: DataFrame, keys: Sequence[str], weights: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Closed form for a linear model: weight times distance from the mean, long form.

    ``columns`` maps a feature to the names of its weight and mean in the one-row table ``weights``.
    """
    rows = df.withColumn("_one", F.lit(1)).join(F.broadcast(weights.withColumn("_one", F.lit(1))), "_one")

    def entry(feature: str, w: str, m: str) -> Column:
        return F.struct(
            F.lit(feature).alias("feature"),
            (F.col(w) * (F.col(feature) - F.col(m))).alias("phi"),
            F.col(feature).alias("value"),
        )

    return rows.select(*keys, F.inline(F.array(*[entry(f, *names) for f, names in columns.items()])))
