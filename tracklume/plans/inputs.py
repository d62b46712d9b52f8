"""Views over the driver's tables that give the library its inputs, each with the same view as portable SQL."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.functions.skew import previous, with_blocks, with_position, without_blocks
from tracklume.functions.scalars import step_length
from tracklume.schema import OBSERVATIONS, TRACK
from tracklume.sources.tables import new_location, read_observations, state_of, stored_observations

_STORED: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _second_value(column: str = "props"):
    return F.regexp_extract(column, "([0-9]+)", 1).cast("double")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``events`` as positions: file = user, particle = event type, frame = order in time."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"),
        F.col("event_type").alias("particle"),
        "ts",
        "event_id",
        F.col("value").alias("x_micron"),
        _second_value().alias("y_micron"),
    )
    return with_position(events, TRACK, ["ts", "event_id"], F.date_trunc("minute", "ts"), "frame").select(
        *TRACK, F.col("frame").cast("int").alias("frame"), "x_micron", "y_micron"
    )


def derive_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation table: positions, step length, shape measures and the columns of the experiment."""
    blocked = with_blocks(positions(spark, sf_dir), TRACK, "frame")
    steps = without_blocks(previous(blocked, ["x_micron", "y_micron"], TRACK, "frame"))
    x, y, file = F.col("x_micron"), F.col("y_micron"), F.col("file")
    comment = (
        F.when(file % 10 == 0, "H2B").when(file % 10 == 1, "stress_control").when(file % 10 < 5, "ok")
    )
    guide = (
        F.when(file % 4 == 0, "pl_1398_chr1")
        .when(file % 4 == 1, "pl_1514_chr1")
        .when(file % 4 == 2, "pl_1362_telo")
        .otherwise("pl_1521_chr10")
    )
    return steps.select(
        "file",
        "particle",
        "frame",
        x,
        y,
        step_length(x - F.col("prev_x_micron"), y - F.col("prev_y_micron")).alias("D"),
        (100 + x).alias("A"),
        (40 + y / 4).alias("P"),
        (F.abs(x - y) / 10).alias("Dist"),
        (file % 2).cast("int").alias("serum"),
        F.when(file % 2 == 1, F.lit(10.0)).otherwise(F.lit(0.3)).alias("serum_conc_percent"),
        ((file % 6) * 10).cast("int").alias("time"),
        guide.alias("guide"),
        comment.alias("comment"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation table, written once per session and scanned by every query, as the movies' table is."""
    key = (spark.sparkContext.applicationId, sf_dir, state_of(table(spark, sf_dir, "events")))
    if key in _STORED:
        try:
            return read_observations(spark, _STORED[key], OBSERVATIONS)
        except AnalysisException:  # the folder was cleared in the meantime
            del _STORED[key]
    path = new_location(spark, "observations")
    stored_observations(derive_observations(spark, sf_dir), path)
    _STORED[key] = path
    return read_observations(spark, path, OBSERVATIONS)


OBSERVATIONS_SQL = """
SELECT file, particle, frame, x_micron, y_micron,
       sqrt(dx*dx + dy*dy) AS D, A, P, Dist, serum, serum_conc_percent, time, guide, comment
FROM (
 SELECT *, x_micron - lag(x_micron) OVER (PARTITION BY file, particle ORDER BY frame) AS dx,
           y_micron - lag(y_micron) OVER (PARTITION BY file, particle ORDER BY frame) AS dy
 FROM (
  SELECT user_id AS file, event_type AS particle,
   CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INT) AS frame,
   value AS x_micron, k AS y_micron, 100 + value AS A, 40 + k / 4 AS P, abs(value - k) / 10 AS Dist,
   CAST(user_id % 2 AS INT) AS serum,
   CASE WHEN user_id % 2 = 1 THEN CAST(10 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS serum_conc_percent,
   CAST((user_id % 6) * 10 AS INT) AS time,
   CASE user_id % 4 WHEN 0 THEN 'pl_1398_chr1' WHEN 1 THEN 'pl_1514_chr1'
                    WHEN 2 THEN 'pl_1362_telo' ELSE 'pl_1521_chr10' END AS guide,
   CASE WHEN user_id % 10 = 0 THEN 'H2B' WHEN user_id % 10 = 1 THEN 'stress_control'
        WHEN user_id % 10 < 5 THEN 'ok' END AS comment
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events) e) b) d
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows: one per (configuration, repeat, fold)."""
    return table(spark, sf_dir, "orders").select(
        (15 + 5 * (F.col("o_orderkey") % 2)).cast("int").alias("kernel_size"),
        F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")).alias("fset"),
        (2 + 2 * (F.col("o_custkey") % 10)).cast("int").alias("epochs"),
        (F.col("o_orderkey") % 20).cast("int").alias("repeat_no"),
        (F.col("o_orderkey") % 4).cast("int").alias("fold"),
        (F.lit(0.5) + (F.col("o_orderkey") % 97) / F.lit(200.0)).alias("accuracy"),
    )


SCORES_SQL = """
SELECT CAST(15 + 5 * (o_orderkey % 2) AS INT) AS kernel_size,
       concat('f', CAST(o_orderkey % 3 AS VARCHAR(3))) AS fset,
       CAST(2 + 2 * (o_custkey % 10) AS INT) AS epochs,
       CAST(o_orderkey % 20 AS INT) AS repeat_no, CAST(o_orderkey % 4 AS INT) AS fold,
       CAST(0.5 AS DOUBLE) + (o_orderkey % 97) / CAST(200 AS DOUBLE) AS accuracy
FROM orders
"""


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution rows: phi per (sample, feature, step), with the run and repeat the sample was explained in."""
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
        .select(
            F.col("vec_id").alias("sample"),
            (F.col("vec_id") % 25).cast("int").alias("run"),
            (F.col("vec_id") % 5).cast("int").alias("repeat_no"),
            (F.col("label") % 2).cast("int").alias("truth"),
            ((F.col("label") + F.col("vec_id")) % 2).cast("int").alias("pred"),
            (F.col("i") % 4).cast("int").alias("feature"),
            F.floor(F.col("i") / 4).cast("int").alias("step"),
            F.col("v").cast("double").alias("phi"),
        )
    )


ATTRIBUTIONS_SQL = """
SELECT vec_id AS sample, CAST(vec_id % 25 AS INT) AS run, CAST(vec_id % 5 AS INT) AS repeat_no,
       CAST(label % 2 AS INT) AS truth, CAST((label + vec_id) % 2 AS INT) AS pred,
       CAST(i % 4 AS INT) AS feature, CAST(floor(i / 4) AS INT) AS step, CAST(v AS DOUBLE) AS phi
FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) e
"""


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-fold membership: one row per (run, sample), with the accuracy of the run."""
    return (
        table(spark, sf_dir, "orders")
        .select(
            (F.col("o_custkey") % 50).cast("int").alias("run"),
            (F.col("o_orderkey") % 289).cast("int").alias("sample"),
            (F.lit(0.5) + (F.col("o_custkey") % 50 * 7 % 50) / F.lit(100.0)).alias("accuracy"),
        )
        .distinct()
    )


MEMBERSHIPS_SQL = """
SELECT DISTINCT CAST(o_custkey % 50 AS INT) AS run, CAST(o_orderkey % 289 AS INT) AS sample,
       CAST(0.5 AS DOUBLE) + (o_custkey % 50 * 7 % 50) / CAST(100 AS DOUBLE) AS accuracy
FROM orders
"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected spots: one row per (file, frame, det_id) with a position; frames are quarters of a day."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"),
        ((F.day("ts") - 1) * 4 + F.floor(F.hour("ts") / 6)).cast("int").alias("frame"),
        F.col("event_id").alias("det_id"),
        F.col("value").alias("x"),
        _second_value().alias("y"),
    )


DETECTIONS_SQL = """
SELECT user_id AS file, CAST((day(ts) - 1) * 4 + floor(hour(ts) / 6) AS INT) AS frame,
       event_id AS det_id, value AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y
FROM events
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True cells of boolean masks: one row per (file, frame, x, y)."""
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("event_type").alias("file"),
            F.day("ts").alias("frame"),
            F.floor(F.col("value") / 10).cast("int").alias("x"),
            F.floor(_second_value() / 10).cast("int").alias("y"),
        )
        .distinct()
    )


CELLS_SQL = """
SELECT DISTINCT event_type AS file, CAST(day(ts) AS INT) AS frame, CAST(floor(value / 10) AS INT) AS x,
       CAST(floor(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 10) AS INT) AS y
FROM events
"""
