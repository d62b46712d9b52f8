"""Row and column selection on observation and feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.functions.scalars import is_one_of
from tracklume.schema import FEATURE_SETS


def guide_filter(df: DataFrame, guides: Sequence[str] = ("1398", "1514")) -> DataFrame:
    return df.where(F.col("guide").rlike("|".join(guides)))


def experiment_filter(
    df: DataFrame,
    comments: Sequence[str] = ("stress_control", "H2B"),
    guides: Sequence[str] = ("1398", "1514"),
    before: int = 40,
) -> DataFrame:
    """Rows of the wanted guides and times whose comment is not one of ``comments``; a missing comment is kept."""
    return guide_filter(df.where(~is_one_of(F.col("comment"), comments)), guides).where(F.col("time") < before)


def exclude_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(~is_one_of(F.col(column), values))


def feature_set(
    df: DataFrame, name: str, keys: Sequence[str], label: str, sources: Mapping[str, str] | None = None
) -> DataFrame:
    """Columns of a named feature set with keys and label; ``sources`` maps set columns to columns of ``df``."""
    sources = sources or {}
    return df.select(*keys, label, *[F.col(sources.get(c, c)).alias(c) for c in FEATURE_SETS[name]])


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the smallest ``order``: a mergeable aggregate instead of a ranking window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*")


def outlier_tracks(features: DataFrame, columns: Sequence[str], count: int = 1) -> DataFrame:
    """Tracks with exactly ``count`` steps beyond three standard deviations."""
    return features.where(F.col("out3sd") == count).select(*columns)


def zero_beyond(df: DataFrame, column: str, limit: float) -> DataFrame:
    return df.withColumn(column, F.when(F.abs(column) > limit, F.lit(0.0)).otherwise(F.col(column)))


def knocked_out(features: DataFrame, columns: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Copies of every row, one per entry of ``groups``, with the columns of that entry set to zero."""
    other = [c for c in features.columns if c not in columns]
    copies = features.withColumn("knockout", F.explode(F.array(*[F.lit(name) for name in groups])))
    out = []
    for c in columns:
        hit = [name for name, members in groups.items() if c in members]
        value = F.col(c).cast("double")
        out.append((F.when(F.col("knockout").isin(hit), F.lit(0.0)).otherwise(value) if hit else value).alias(c))
    return copies.select("knockout", *other, *out)
