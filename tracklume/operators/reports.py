"""Summaries of score tables: curves, grids, run selection and membership counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.functions.scalars import ratio
from tracklume.functions.skew import attach
from tracklume.operators.stats import percentiles


def score_summary(df: DataFrame, by: Sequence[str], score: str = "accuracy") -> DataFrame:
    """Mean, sample and population deviation, count and standard error of a score per configuration."""
    return df.groupBy(*by).agg(
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
        F.stddev_pop(score).alias("std_pop"),
        F.count(score).alias("n"),
        ratio(F.stddev_samp(score), F.sqrt(F.count(score).cast("double"))).alias("sem"),
    )


def score_curve(df: DataFrame, by: str = "epochs", upto: int | None = None, score: str = "accuracy") -> DataFrame:
    """Mean score by training length, first within each repeat, then over the repeats."""
    kept = df if upto is None else df.where(F.col(by) <= upto)
    per_repeat = kept.groupBy(by, "repeat_no").agg(F.avg(score).alias("_s"))
    return per_repeat.groupBy(by).agg(F.avg("_s").alias("mean"), F.count(F.lit(1)).alias("repeats"))


def score_grid(df: DataFrame, rows: str, columns: str, values: Sequence, score: str = "accuracy") -> DataFrame:
    """Mean score as a grid: one row per value of ``rows``, one column per declared value of ``columns``."""
    wide = df.groupBy(rows).pivot(columns, list(values)).agg(F.avg(score))
    return wide.select(rows, *[F.col(f"`{v}`").alias(f"{columns}_{v}") for v in values])


def best_cell(df: DataFrame, parameters: Sequence[str], score: str = "accuracy") -> DataFrame:
    """Parameters with the highest mean score; the smallest parameters on a tie."""
    means = df.groupBy(*parameters).agg(F.avg(score).alias("mean"))
    return means.orderBy(F.desc(F.round("mean", 12)), *parameters).limit(1)


def curves_wide(df: DataFrame, sets: Sequence[str], by: str = "epochs", score: str = "accuracy") -> DataFrame:
    """One row per training length with mean and deviation of each feature set."""
    wide = df.groupBy(by).pivot("fset", list(sets)).agg(
        F.avg(score).alias("mean"), F.stddev_samp(score).alias("std")
    )
    return wide.select(by, *[F.col(f"{s}_{m}").alias(f"{m}_{s}") for s in sets for m in ("mean", "std")])


def alignment(df: DataFrame, by: str = "epochs", group: str = "fset") -> DataFrame:
    """Coverage of each training length by the feature sets, with a flag where one of them is absent."""
    present = df.select(group, by).distinct()
    per_step = present.groupBy(by).agg(F.count(F.lit(1)).alias("sets"))
    total = present.select(group).distinct().agg(F.count(F.lit(1)).alias("_all")).withColumn("_one", F.lit(1))
    return (
        per_step.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .select(by, "sets", F.when(F.col("sets") == F.col("_all"), 1).otherwise(0).alias("aligned"))
    )


def target_run(df: DataFrame, target: float = 0.98, within: float = 0.02, score: str = "accuracy") -> DataFrame:
    """First fold, in order of repeat and fold, whose score is within ``within`` of the target."""
    hit = F.abs(F.lit(target) - F.col(score)) < within
    order = [c for c in ("repeat_no", "fold", "kernel_size", "fset", "epochs", score) if c in df.columns]
    return df.where(hit).orderBy(*order).limit(1)


def fold_metrics(df: DataFrame, by: Sequence[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 per group; an undefined ratio counts as zero."""
    def hits(t: int, p: int) -> Column:
        return F.sum(F.when((F.col(truth) == t) & (F.col(pred) == p), 1).otherwise(0))

    counted = df.groupBy(*by).agg(
        hits(1, 1).alias("tp"), hits(0, 1).alias("fp"), hits(1, 0).alias("fn"), hits(0, 0).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return counted.select(
        *by,
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), zero).alias("recall"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
    )


def run_groups(
    runs: DataFrame, low: float, high: float, strict: bool, score: str = "accuracy"
) -> DataFrame:
    """Mark runs at or beyond the lower and upper percentile of the score (strictly beyond if ``strict``)."""
    limits = percentiles(runs, score, [low, high])
    wide = limits.agg(
        F.max(F.when(F.col("q") == low, F.col("value"))).alias("_lo"),
        F.max(F.when(F.col("q") == high, F.col("value"))).alias("_hi"),
    ).withColumn("_one", F.lit(1))
    rows = runs.withColumn("_one", F.lit(1)).join(F.broadcast(wide), "_one")
    above = F.col(score) > F.col("_hi") if strict else F.col(score) >= F.col("_hi")
    below = F.col(score) < F.col("_lo") if strict else F.col(score) <= F.col("_lo")
    return rows.select(
        *runs.columns, above.cast("int").alias("is_high"), below.cast("int").alias("is_low")
    )


def membership_counts(members: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """How often a sample was in the training fold: all runs, accurate runs, inaccurate runs, rescaled and compared.

    The rescaling subtracts the joint minimum and divides by the joint maximum.
    """
    runs = members.groupBy("run", "accuracy").agg(F.count(F.lit(1)).alias("_size"))
    marked = run_groups(runs, low, high, strict=True).select("run", "_size", "is_high", "is_low")
    counts = attach(members, marked, ["run"], "_size", ["sample"]).groupBy("sample").agg(
        F.count(F.lit(1)).alias("in_all"), F.sum("is_high").alias("in_high"), F.sum("is_low").alias("in_low")
    )
    joint = counts.agg(
        F.least(F.min("in_high"), F.min("in_low")).alias("_min"),
        F.greatest(F.max("in_high"), F.max("in_low")).alias("_max"),
    ).withColumn("_one", F.lit(1))
    rows = counts.withColumn("_one", F.lit(1)).join(F.broadcast(joint), "_one")
    return rows.select(
        "sample",
        "in_all",
        "in_high",
        "in_low",
        (F.col("in_high") - F.col("in_low")).alias("difference"),
        ratio((F.col("in_high") - F.col("_min")).cast("double"), F.col("_max")).alias("high_scaled"),
        ratio((F.col("in_low") - F.col("_min")).cast("double"), F.col("_max")).alias("low_scaled"),
    )
