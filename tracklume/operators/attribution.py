"""Attribution tables in long form: (run, sample, feature, step, phi, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def over_time(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attribution summed and input averaged over the steps of a series."""
    return df.groupBy(*keys, "feature").agg(F.sum("phi").alias("phi"), F.avg("value").alias("value"))


def per_sample(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("phi").alias("phi"))


def extreme_samples(df: DataFrame) -> DataFrame:
    """Among correct predictions, the sample with the largest sum for class 0 and with the smallest for class 1."""
    sums = per_sample(df.where(F.col("truth") == F.col("pred")), ["truth", "sample"])
    top = F.max_by(F.struct("sample", "phi"), F.struct(F.col("phi"), -F.col("sample")))
    low = F.min_by(F.struct("sample", "phi"), F.struct("phi", "sample"))
    one = sums.groupBy(F.col("truth").alias("label")).agg(top.alias("_top"), low.alias("_low"))
    picked = F.when(F.col("label") == 0, F.col("_top")).otherwise(F.col("_low"))
    return one.select("label", picked.alias("_p")).select("label", "_p.*")


def averaged(df: DataFrame, keys: Sequence[str], features: Sequence) -> DataFrame:
    """Mean attribution and mean value per track over all repeats, one column pair per declared feature."""
    wide = df.groupBy(*keys).pivot("feature", list(features)).agg(
        F.avg("phi").alias("phi"), F.avg("value").alias("value")
    )
    return wide.select(
        *keys,
        *[F.col(f"{f}_phi").alias(f"shap_{f}") for f in features],
        *[F.col(f"{f}_value").alias(f"value_{f}") for f in features],
    )


def importance(df: DataFrame) -> DataFrame:
    """Mean absolute and mean signed attribution per feature."""
    return df.groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean"), F.count(F.lit(1)).alias("n")
    )


def dependence(df: DataFrame, feature) -> DataFrame:
    """Value and attribution of one feature, row by row."""
    return df.where(F.col("feature") == feature)
