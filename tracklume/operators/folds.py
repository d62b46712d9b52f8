"""Deterministic group-aware folds: a group never appears in two folds.

Groups are ranked by an md5 of seed, repeat and group, so the same groups get the same folds on any engine and under any
partitioning.  Ranks are built per prefix of the hash, which spreads one large stratum over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.functions.skew import attach, with_position


def _hash(seed: int, repeat: Column, group: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), repeat.cast("string"), F.lit("|"), F.col(group).cast("string")))


def groups(df: DataFrame, group: str = "file", label: str = "serum") -> DataFrame:
    """One row per group: majority label and number of rows."""
    return df.groupBy(group).agg(
        F.when(F.avg(label) > 0.5, 1).otherwise(0).alias(label), F.count(F.lit(1)).alias("n_rows")
    )


def stratified_group_folds(
    df: DataFrame,
    k: int = 4,
    repeats: int = 1,
    seed: int = 7,
    group: str = "file",
    label: str = "serum",
    balance: str = "groups",
) -> DataFrame:
    """Fold of every group in every repeat, dealt round robin inside each label.

    ``balance='groups'`` evens out the number of groups; ``balance='rows'`` deals the groups from the largest to the
    smallest back and forth, which evens out the rows.
    """
    listed = (
        groups(df, group, label)
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("_h", _hash(seed, F.col("repeat_no"), group))
    )
    prefix = F.substring("_h", 1, 3)
    if balance == "groups":
        order, block = ["_h", group], prefix
    else:
        order, block = [F.desc("n_rows"), "_h", group], F.struct(-F.col("n_rows"), prefix)
    ranked = with_position(listed, ["repeat_no", label], order, block, "_rank")
    dealt = _round_robin(k) if balance == "groups" else _back_and_forth(k)
    return ranked.select("repeat_no", group, label, "n_rows", dealt.cast("int").alias("fold"))


def _round_robin(k: int) -> Column:
    return F.col("_rank") % k


def _back_and_forth(k: int) -> Column:
    place = F.col("_rank") % k
    return F.when(F.floor(F.col("_rank") / k) % 2 == 0, place).otherwise(k - 1 - place)


def group_folds(df: DataFrame, k: int = 4, group: str = "file", label: str = "serum") -> DataFrame:
    """Folds without shuffling: groups by falling size, dealt back and forth."""
    listed = groups(df, group, label).withColumn("_all", F.lit(0)).withColumn("_h", _hash(0, F.lit(0), group))
    block = F.struct(-F.col("n_rows"), F.substring("_h", 1, 3))
    ranked = with_position(listed, ["_all"], [F.desc("n_rows"), "_h", group], block, "_rank")
    return ranked.select(group, "n_rows", _back_and_forth(k).cast("int").alias("fold"))


def group_shuffle_splits(
    df: DataFrame, splits: int = 20, test_share: float = 0.25, seed: int = 7, group: str = "file"
) -> DataFrame:
    """Independent hold-out splits: in each, the groups with the smallest hashes make up ``test_share`` of the groups."""
    listed = (
        df.select(group)
        .distinct()
        .withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        .withColumn("_h", _hash(seed, F.col("split"), group))
    )
    ranked = with_position(listed, ["split"], ["_h", group], F.substring("_h", 1, 3), "_rank")
    per_split = listed.groupBy("split").agg(F.ceil(F.count(F.lit(1)) * F.lit(test_share)).alias("_test"))
    # one row per split: at most ``splits`` rows
    return ranked.join(F.broadcast(per_split), "split").select(
        "split", group, F.when(F.col("_rank") < F.col("_test"), 1).otherwise(0).alias("is_test")
    )


def leave_one_group_out(df: DataFrame, group: str = "file") -> DataFrame:
    """Every group is its own fold, numbered without gaps."""
    listed = df.select(group).distinct().withColumn("_all", F.lit(0)).withColumn("_h", _hash(0, F.lit(0), group))
    ranked = with_position(listed, ["_all"], ["_h", group], F.substring("_h", 1, 3), "fold")
    return ranked.select(group, "fold")


def in_one_row(folds: DataFrame, group: str = "file") -> DataFrame:
    """Folds of all repeats of a group as one array ``folds`` of (repeat_no, fold), in the order of the repeats."""
    listed = F.array_sort(F.collect_list(F.struct("repeat_no", "fold"))).alias("folds")
    return folds.groupBy(group).agg(F.max("n_rows").alias("n_rows"), listed)


def with_fold(df: DataFrame, folds: DataFrame, spread_by: tuple[str, ...], group: str = "file") -> DataFrame:
    """Fold (and repeat, where there are several) of each row; a group with very many rows is salted."""
    wanted = [c for c in ("repeat_no", "fold", "folds") if c in folds.columns]
    return attach(df, folds.select(group, "n_rows", *wanted), [group], "n_rows", spread_by).drop("n_rows")
