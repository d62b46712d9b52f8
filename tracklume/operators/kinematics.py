"""Per-step quantities of tracks: differences, headings, turning angles and outlier flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.functions.scalars import ratio, step_length, undirected_angle, wrapped
from tracklume.functions.skew import attach_to_blocks, block_span, previous, with_blocks, without_blocks
from tracklume.schema import FRAME, TRACK


def blocked_deltas(blocked: DataFrame, x: str = "x_micron", y: str = "y_micron") -> DataFrame:
    """First differences ``dX``, ``dY`` per track on rows from ``with_blocks``."""
    rows = previous(blocked, [x, y], TRACK, FRAME)
    return rows.withColumns(
        {"dX": F.col(x) - F.col("prev_" + x), "dY": F.col(y) - F.col("prev_" + y)}
    ).drop("prev_" + x, "prev_" + y)


def track_deltas(df: DataFrame, x: str = "x_micron", y: str = "y_micron") -> DataFrame:
    """First differences and step length ``D``; the first row of a track has none."""
    rows = without_blocks(blocked_deltas(with_blocks(df, TRACK, FRAME), x, y))
    return rows.withColumn("D", step_length(F.col("dX"), F.col("dY")))


def headings(df: DataFrame) -> DataFrame:
    """Heading of each step without (``angle``) and with (``direction``) regard to its sense."""
    return df.withColumns(
        {
            "angle": undirected_angle(F.col("dX"), F.col("dY")),
            "direction": F.when((F.col("dX") == 0) & (F.col("dY") == 0), None).otherwise(
                F.atan2("dY", "dX")
            ),
        }
    )


def _turns(df: DataFrame) -> DataFrame:
    """Deltas, headings and their change against the previous step, on rows with at least two predecessors.

    ``_step`` marks that a row has a predecessor; the second ``previous`` carries it one row on, so rows whose
    predecessor is the first row of the track are recognised whatever their frame number is.
    """
    blocked = with_blocks(df, TRACK, FRAME)
    first = previous(blocked, ["x_micron", "y_micron", "A", "P", FRAME], TRACK, FRAME)
    steps = headings(
        first.withColumns(
            {
                "dX": F.col("x_micron") - F.col("prev_x_micron"),
                "dY": F.col("y_micron") - F.col("prev_y_micron"),
                "darea": F.col("A") - F.col("prev_A"),
                "dperimeter": F.col("P") - F.col("prev_P"),
                "_step": F.col("prev_frame").isNotNull(),
            }
        )
    ).withColumn("t", ratio(F.col("dY"), F.col("dX")))
    second = previous(steps, ["t", "angle", "direction", "_step"], TRACK, FRAME)
    return without_blocks(
        second.where("prev__step").withColumns(
            {
                "dt": F.col("t") - F.col("prev_t"),
                "dangle": F.col("angle") - F.col("prev_angle"),
                "dturn": F.col("direction") - F.col("prev_direction"),
            }
        )
    )


def turning_angles(df: DataFrame) -> DataFrame:
    """Change of heading, wrapped, and its absolute value."""
    turn = wrapped(F.col("dturn"))
    return _turns(df).select(*TRACK, FRAME, "dturn", turn.alias("turn"), F.abs(turn).alias("turn_abs"))


def dynamics(df: DataFrame) -> DataFrame:
    """First and second order changes per step, without the two warm-up rows of each track."""
    return _turns(df).select(
        *[c for c in df.columns if c not in ("D",)],
        F.col("dX").alias("dx"),
        F.col("dY").alias("dy"),
        step_length(F.col("dX"), F.col("dY")).alias("dxy"),
        "angle",
        "dangle",
        "dperimeter",
        "darea",
    )


def directionality(df: DataFrame) -> DataFrame:
    """Mean reciprocal change of heading per track, five ways, plain and weighted by step length; and persistence."""
    turn = wrapped(F.col("dturn"))
    rows = _turns(df).select(
        *TRACK,
        "dX",
        "dY",
        step_length(F.col("dX"), F.col("dY")).alias("D"),
        "dt",
        F.col("dangle").alias("d_theta"),
        F.col("dturn").alias("d_theta2"),
        turn.alias("d_theta2_minabs"),
        F.abs(turn).alias("d_theta2_minabs_abs"),
    )
    changes = ["dt", "d_theta", "d_theta2", "d_theta2_minabs", "d_theta2_minabs_abs"]
    inverse = {c: ratio(F.lit(1.0), F.col(c)) for c in changes}
    total = step_length(F.coalesce(F.sum("dX"), F.lit(0.0)), F.coalesce(F.sum("dY"), F.lit(0.0)))
    return rows.groupBy(*TRACK).agg(
        *[F.avg(inverse[c]).alias("rec_" + c) for c in changes],
        *[F.avg(inverse[c] * F.col("D")).alias("D_norm_rec_" + c) for c in changes],
        ratio(total, F.coalesce(F.sum("D"), F.lit(0.0))).alias("Pers"),
    )


def with_track_stats(df: DataFrame, *stats) -> DataFrame:
    """Aggregates of a track on each of its rows, split by block where the track is very long."""
    blocked = with_blocks(df, TRACK, FRAME)
    per_track = blocked.groupBy(*TRACK).agg(*stats, *block_span())
    return without_blocks(attach_to_blocks(blocked, per_track, TRACK))


def step_outliers(df: DataFrame) -> DataFrame:
    """Steps longer than the mean of their track by two and three standard deviations."""
    rows = with_track_stats(df, F.avg("D").alias("MD"), F.stddev_samp("D").alias("SD"))
    return rows.withColumns({f"out{k}sd": beyond(k) for k in (2, 3)})


def beyond(k: int):
    return F.when(F.col("D") > F.col("MD") + k * F.col("SD"), 1).otherwise(0)


def range_normalised(df: DataFrame, x: str = "x_micron", y: str = "y_micron") -> DataFrame:
    """Positions relative to the smallest position of the track, with the range."""
    stats = [f(c).alias(f"{c}_{n}") for c in (x, y) for f, n in ((F.min, "min"), (F.max, "max"))]
    return with_track_stats(df, *stats).withColumns(
        {"x_norm": F.col(x) - F.col(x + "_min"), "y_norm": F.col(y) - F.col(y + "_min")}
    )


def with_length(df: DataFrame, name: str = "nframes") -> DataFrame:
    """Number of observed frames of the track on each of its rows."""
    return with_track_stats(df, F.count(FRAME).alias(name))


def drop_short(df: DataFrame, minimum: int) -> DataFrame:
    """Rows of the tracks with at least ``minimum`` frames."""
    return with_length(df, "_n").where(F.col("_n") >= minimum).drop("_n")


def short_tracks(df: DataFrame, minimum: int) -> DataFrame:
    return df.groupBy(*TRACK).agg(F.count(FRAME).alias("nframes")).where(F.col("nframes") < minimum)
