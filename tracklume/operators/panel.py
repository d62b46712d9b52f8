"""Panels: tracks of one length as ordered series, and the ways to scale them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.functions.scalars import ratio
from tracklume.functions.skew import attach_to_blocks, block_span, with_blocks, without_blocks
from tracklume.operators.features import with_overall
from tracklume.operators.kinematics import with_track_stats
from tracklume.schema import FRAME, TRACK

SERIES_FRAMES: int | None = None  # frames of one array; None: a track is one series, however long it is


def instance_key() -> Column:
    return F.concat_ws("__", F.col("file").cast("string"), F.col("particle").cast("string"))


def label_from_percent(column: str = "serum_conc_percent") -> Column:
    """10 becomes 1, 0.3 becomes 0."""
    return (F.col(column) / 10).cast("int")


def modal_length(lengths: DataFrame, name: str = "nframes") -> DataFrame:
    """One row: the track length that covers most rows, the smallest one on a tie."""
    rows = lengths.groupBy(name).agg(F.sum(name).alias("_rows"))
    return rows.agg(F.max_by(name, F.struct(F.col("_rows"), -F.col(name))).alias(name))


def modal_tracks(df: DataFrame, name: str = "nframes") -> DataFrame:
    """Rows of the tracks that have the modal length."""
    blocked = with_blocks(df, TRACK, FRAME)
    lengths = blocked.groupBy(*TRACK).agg(F.count(FRAME).alias(name), *block_span())
    kept = lengths.join(F.broadcast(modal_length(lengths, name)), name)
    return without_blocks(attach_to_blocks(blocked, kept, TRACK))


def nested(df: DataFrame, values: Sequence[str], label: str = "serum_conc_percent") -> DataFrame:
    """Tracks as series: one row per track, each value column an array in frame order; ``chunk`` is 0.

    Only where ``SERIES_FRAMES`` is set, a track that spans more frames is cut, counted from its own first frame, and its pieces are numbered by
    ``chunk``.  Class, group and length are those of the whole track in every piece.  No registered query sets it.
    """
    whole = with_track_stats(
        df, F.min(FRAME).alias("_first"), F.max(label).alias("_label"), F.count(F.lit(1)).alias("_length")
    )
    chunk = F.lit(0) if SERIES_FRAMES is None else F.floor((F.col(FRAME) - F.col("_first")) / F.lit(SERIES_FRAMES)).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct(FRAME, *values)))
    rows = whole.withColumn("chunk", chunk).groupBy(*TRACK, "chunk").agg(
        ordered.alias("_s"), F.first("_label").alias("_label"), F.first("_length").alias("_length")
    )
    return rows.select(
        instance_key().alias("fp"),
        "chunk",
        label_from_percent("_label").alias("class"),
        F.col("file").alias("group"),
        F.col("_length").cast("int").alias("length"),
        *[F.col("_s").getField(v).alias(v) for v in values],
    )


def dense(df: DataFrame, values: Sequence[str], label: str = "serum_conc_percent") -> DataFrame:
    """Series of one length with one row per (track, feature): the sample × feature × step array, long in features."""
    series = nested(df, values, label)
    named = F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).alias("series")) for v in values])
    return series.select("fp", "chunk", "class", "group", F.inline(named))


def melted(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "feature") -> DataFrame:
    """Long form: one row per key and value column."""
    pairs = F.array(*[F.struct(F.lit(v).alias(name), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(*keys, F.inline(pairs))


def frames_of(df: DataFrame) -> list[int]:
    """All frames that occur, ascending: a list for :func:`wide_by_frame` where tracks are known to be short."""
    return sorted(r[0] for r in df.select(FRAME).where(F.col(FRAME).isNotNull()).distinct().collect())


def wide_blocks(df: DataFrame, values: Sequence[str], width: int = 32, without: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """One row per track and block of ``width`` frames, each measure an array with one place per frame of the block.

    The schema does not depend on the data, however long the tracks are; frames that a track does not have are NULL, and so are the
    (measure, frame) places of ``without``.  Blocks without any row of the track are left out.  ``first_frame`` is the
    first frame of the block.  Rows without a frame belong to no block.
    """
    offset = F.pmod(F.col(FRAME), F.lit(width))
    rows = df.where(F.col(FRAME).isNotNull()).withColumn("first_frame", (F.col(FRAME) - offset).cast("int"))
    for value, frame in without:
        rows = rows.withColumn(value, F.when(F.col(FRAME) != frame, F.col(value)))
    places = [F.array(*[F.max(F.when(offset == i, F.col(v))) for i in range(width)]).alias(v) for v in values]
    return rows.groupBy(*TRACK, "first_frame").agg(*places)


def wide_by_frame(df: DataFrame, values: Sequence[str], frames: Sequence[int], drop: Sequence[str] = ()) -> DataFrame:
    """One column per (measure, frame) for a stated list of frames; ``drop`` removes columns of the result.

    Meant for few frames; :func:`wide_blocks` takes tracks of any length.
    """
    wide = df.groupBy(*TRACK).pivot(FRAME, list(frames)).agg(*[F.max(v).alias(v) for v in values])
    if len(values) == 1:
        wide = wide.select(*TRACK, *[F.col(f"`{f}`").alias(f"{f}_{values[0]}") for f in frames])
    named = wide.select(*TRACK, *[F.col(f"`{f}_{v}`").alias(f"{v}_{f}") for v in values for f in frames])
    return named.drop(*drop)


def _zscore(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def scale_by_series(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Each series scaled by its own mean and population standard deviation; a constant series has no scaled value."""
    stats = [f(v).alias(f"{n}_{v}") for v in values for f, n in ((F.avg, "_m"), (F.stddev_pop, "_s"))]
    rows = with_track_stats(df, *stats)
    scaled = {v: ratio(F.col(v) - F.col(f"_m_{v}"), F.col(f"_s_{v}")) for v in values}
    return rows.withColumns(scaled).select(*df.columns)


def train_fold_stats(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of each column over all folds but one, for every fold.

    One aggregate gives (n, mean, squared deviations) per fold and column; the train set of a fold is the merge of the
    others, which neither rescans the rows nor subtracts large sums.  The result has one row per (repeat and) fold with
    arrays ``_mean`` and ``_std`` in the order of ``values``.
    """
    keys = [c for c in ("repeat_no",) if c in df.columns]
    moments = [
        F.struct(
            F.lit(i).alias("i"),
            F.count(v).cast("double").alias("n"),
            F.coalesce(F.avg(v), F.lit(0.0)).alias("m"),
            F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("q"),
        )
        for i, v in enumerate(values)
    ]
    per_fold = df.groupBy(*keys, "fold").agg(F.array(*moments).alias("_all")).select(*keys, "fold", F.inline("_all"))
    # one short array per column: as many entries as folds
    listed = per_fold.groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("fold", "n", "m", "q"))).alias("_all"))

    def total(term) -> Column:
        return F.aggregate("_others", F.lit(0.0), lambda acc, s: acc + term(s))

    merged = (
        listed.withColumn("fold", F.explode(F.col("_all").fold))
        .withColumn("_others", F.filter("_all", lambda s: s.fold != F.col("fold")))
        .withColumn("_n", total(lambda s: s.n))
        .withColumn("_m", ratio(total(lambda s: s.n * s.m), F.col("_n")))
        .withColumn("_q", total(lambda s: s.q + s.n * (s.m - F.col("_m")) * (s.m - F.col("_m"))))
        .withColumn("_s", F.sqrt(ratio(F.col("_q"), F.col("_n"))))
    )
    ordered = merged.groupBy(*keys, "fold").agg(F.array_sort(F.collect_list(F.struct("i", "_m", "_s"))).alias("_by_column"))
    return ordered.select(*keys, "fold", F.col("_by_column")["_m"].alias("_mean"), F.col("_by_column")["_s"].alias("_std"))


def _scaled(rows: DataFrame, values: Sequence[str], columns: Sequence[str]) -> DataFrame:
    scores = {v: _zscore(F.col(v), F.col("_mean")[i], F.col("_std")[i]) for i, v in enumerate(values)}
    return rows.select(*[scores[c].alias(c) if c in scores else F.col(c) for c in columns])


def scale_held_out(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Rows of every fold scaled by the statistics of the other folds; a constant column is only centred."""
    keys = [c for c in ("repeat_no", "fold") if c in df.columns]
    stats = F.broadcast(train_fold_stats(df, values))  # one row per repeat and fold
    return _scaled(df.join(stats, keys), values, df.columns)


def scale_for_fold(df: DataFrame, values: Sequence[str], stats: DataFrame, fold: int) -> DataFrame:
    """All rows scaled by the train statistics of one fold, ready to fit on the rows outside of it."""
    one = F.broadcast(stats.where(F.col("fold") == fold).drop("fold").withColumn("_one", F.lit(1)))
    return _scaled(df.withColumn("_one", F.lit(1)).join(one, "_one"), values, df.columns)


def max_scaled(df: DataFrame, values: Sequence[str], train: Column | None = None) -> DataFrame:
    """Columns divided by their maximum over the training rows (all rows by default)."""
    picked = [F.col(v) if train is None else F.when(train, F.col(v)) for v in values]
    rows = with_overall(df, *[F.max(p).alias(f"_max_{v}") for p, v in zip(picked, values)])
    return rows.withColumns({v: ratio(F.col(v), F.col(f"_max_{v}")) for v in values}).select(*df.columns)


def impute_mean(df: DataFrame, values: Sequence[str], train: Column | None = None) -> DataFrame:
    """Missing values replaced by the mean over the training rows (all rows by default)."""
    picked = [F.col(v) if train is None else F.when(train, F.col(v)) for v in values]
    rows = with_overall(df, *[F.avg(p).alias(f"_avg_{v}") for p, v in zip(picked, values)])
    return rows.withColumns({v: F.coalesce(F.col(v), F.col(f"_avg_{v}")) for v in values}).select(*df.columns)


def one_hot(df: DataFrame, column: str, classes: Sequence[int]) -> DataFrame:
    return df.select("*", *[F.when(F.col(column) == c, 1).otherwise(0).alias(f"{column}_{c}") for c in classes])


def decoded(df: DataFrame, columns: dict[int, str], name: str) -> DataFrame:
    """Class with the largest entry, the smallest class on a tie."""
    best = F.greatest(*[F.struct(F.col(c).alias("v"), F.lit(-k).alias("k")) for k, c in columns.items()])
    return df.withColumn(name, -best.k)
