"""One row per track: twenty features from mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.functions.scalars import ratio, step_length
from tracklume.functions.skew import attach, attach_to_blocks, block_span, with_blocks
from tracklume.operators.kinematics import beyond, blocked_deltas
from tracklume.schema import FEATURES, FRAME, TRACK
from tracklume.sources.tables import stored


def _total(column: str):
    return F.coalesce(F.sum(column), F.lit(0.0))


def _edge(by, column: str):
    """First or last present value in frame order."""
    return by(F.col(column), F.when(F.col(column).isNotNull(), F.col(FRAME)))


def track_table(df: DataFrame, keep: tuple[str, ...] = ("serum",)) -> DataFrame:
    """Features of a track that need only its own rows.

    One pass builds the aggregates; a second, two-column pass counts the steps beyond the track's own limits.
    """
    blocked = with_blocks(df, TRACK, FRAME)
    aggregates = blocked_deltas(blocked).groupBy(*TRACK).agg(
        *[F.min_by(c, FRAME).alias(c) for c in keep],
        F.avg("D").alias("MD"),
        F.max("D").alias("MaxD"),
        F.var_samp("D").alias("VarD"),
        _total("D").alias("_path"),
        step_length(_total("dX"), _total("dY")).alias("TD"),
        F.avg("A").alias("MA"),
        F.avg("P").alias("MP"),
        F.avg("Dist").alias("MDist"),
        F.var_samp("Dist").alias("VarDist"),
        (F.max("Dist") - F.min("Dist")).alias("DistR"),
        (_edge(F.max_by, "Dist") - _edge(F.min_by, "Dist")).alias("TDist"),
        F.regr_slope("Dist", FRAME).alias("sDist"),
        F.regr_slope("A", FRAME).alias("sA"),
        F.regr_slope("P", FRAME).alias("sP"),
        *block_span(),
    )
    stats = aggregates.withColumns(
        {
            "SD": F.sqrt("VarD"),
            "rVarD": ratio(F.col("VarD"), F.col("MD")),
            "rVarDist": ratio(F.col("VarDist"), F.col("MDist")),
            "Pers": ratio(F.col("TD"), F.col("_path")),
        }
    ).drop("_path")
    values = [c for c in stats.columns if c not in (*TRACK, "_lo", "_hi")]
    steps = blocked.select(*TRACK, FRAME, "D", "_block")
    return (
        attach_to_blocks(steps, stats, TRACK)
        .groupBy(*TRACK)
        .agg(
            *[F.any_value(c).alias(c) for c in values],
            F.sum(beyond(2)).alias("out2sd"),
            F.sum(beyond(3)).alias("out3sd"),
        )
        .drop("SD")
    )


def sibling_masks(tracks: DataFrame) -> DataFrame:
    """Mark the tracks of a file that reach its largest mean step (``ifFast``) and mean distance (``ifCentr``)."""
    best = tracks.groupBy("file").agg(
        F.max("MD").alias("_fast"), F.max("MDist").alias("_centr"), F.count(F.lit(1)).alias("_size")
    )
    return (
        attach(tracks, best, ["file"], "_size", ["particle"])
        .withColumns(
            {
                "ifFast": F.when(F.col("MD") == F.col("_fast"), 1).otherwise(0),
                "ifCentr": F.when(F.col("MDist") == F.col("_centr"), 1).otherwise(0),
            }
        )
        .drop("_fast", "_centr", "_size")
    )


def track_features(df: DataFrame, keep: tuple[str, ...] = ("serum",)) -> DataFrame:
    """The twenty features of every track with its keys and the ``keep`` columns.

    The track table is written once, because the file-wide maxima read it again; it is a small part of the input.
    """
    tracks = stored(track_table(df, keep), "tracks")
    return sibling_masks(tracks).select(*TRACK, *keep, *FEATURES)


def circularity(tracks: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Roundness of each file from its first track, relative to the largest one."""
    first = tracks.groupBy("file").agg(*[F.min_by(c, "particle").alias(c) for c in ("MA", "MP", *carried)])
    shape = first.withColumn("shape", ratio(4 * F.pi() * F.col("MA"), F.pow(F.col("MP"), F.lit(2.0))))
    return with_overall(shape, F.max("shape").alias("_most")).select(
        "file", *carried, "MA", "MP", ratio(F.col("shape"), F.col("_most")).alias("circularity")
    )


def with_overall(df: DataFrame, *stats) -> DataFrame:
    """Add statistics of the whole table to every row: one row, broadcast on a constant key."""
    one = df.agg(*stats).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")
