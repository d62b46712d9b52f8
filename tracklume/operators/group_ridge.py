"""Ridge scores that leave out one group at a time, for any number of groups, without refitting from rows.

The sums of products of a group are taken off the sums of all rows; what is left are the sums of the training rows, from which its
weights follow in closed form.  Sums are one row per group and all groups are solved side by side in Spark; the driver sees the total
only.  The state is columns squared per group and does not grow with the rows of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.functions.skew import attach
from tracklume.operators.ridge import _Fit, _matrix
from tracklume.sources.tables import stored

MAX_COLUMNS = 512
_GROUPS_HELD = 256  # groups whose sums a task keeps before it hands them on


def _summed(name: str):
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(name)))).alias(name)


def _group_sums(batches: Iterator[pd.DataFrame], centre: np.ndarray) -> Iterator[pd.DataFrame]:
    """Sums of products of the groups of a task, in tables of at most ``_GROUPS_HELD`` groups, however many groups a batch has."""

    def table(sums: dict) -> pd.DataFrame:
        return pd.DataFrame({"group": pd.Series(list(sums), dtype=object), "part": [s.ravel() for s in sums.values()]})

    sums: dict = {}
    for batch in batches:
        for key, part in batch.groupby("group"):
            if key not in sums and len(sums) >= _GROUPS_HELD:
                yield table(sums)
                sums = {}
            x, y = _matrix(part)
            z = np.column_stack([np.ones(len(y)), x - centre, y])
            sums[key] = sums.get(key, 0.0) + z.T @ z
    if sums:
        yield table(sums)


def group_weights(df: DataFrame, width: int, group: str, penalty: float = 1.0) -> DataFrame:
    """Per group its rows, and weights and intercept fitted on all other groups: (group, n, weights, intercept).

    ``df`` has ``group``, ``label`` (0 or 1) and ``vec``, an array of ``width`` numbers without nulls.  Columns are centred and
    scaled to length one on the training rows.  The only group of a table has no training rows and gets no row here.
    """
    if width > MAX_COLUMNS:
        raise ValueError(f"{width} columns; sums per group are kept for at most {MAX_COLUMNS}")
    rows = df.select(F.col(group).alias("group"), "label", "vec").where("group is not null")
    kind = rows.schema["group"].dataType.simpleString()
    out_type = f"group {kind}, n long, weights array<double>, intercept double"
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], out_type).withColumnRenamed("group", group)
    centre = np.asarray(rows.agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("m")).first()["m"])

    parts = rows.mapInPandas(lambda batches: _group_sums(batches, centre), f"group {kind}, part array<double>")
    own = stored(parts.groupBy("group").agg(_summed("part")), "group-sums")
    whole = np.asarray(own.agg(_summed("part")).first()["part"]).reshape(width + 2, width + 2)

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, part in zip(batch["group"], batch["part"]):
                sums = np.asarray(part).reshape(whole.shape)
                if whole[0, 0] - sums[0, 0] > 0.5:
                    weights, intercept = _Fit(whole - sums, range(width), centre).weights(penalty)
                    out.append((key, round(sums[0, 0]), weights.tolist(), intercept))
            if out:
                found = pd.DataFrame(out, columns=["group", "n", "weights", "intercept"])
                yield found.astype({"group": object})

    solutions = own.mapInPandas(solved, out_type)
    return solutions.withColumnRenamed("group", group)


def leave_one_group_out_scores(df: DataFrame, width: int, group: str, key: str, penalty: float = 1.0) -> DataFrame:
    """Every row with its score from the weights of all other groups: (group, key, truth, pred, score).

    Rows without a group, and all rows where there is one group only, have no score and are left out.
    """
    weights = stored(group_weights(df, width, group, penalty), "group-weights")
    scored = attach(df, weights, [group], "n", [key])
    products = F.zip_with("vec", "weights", lambda a, b: a * b)
    score = F.aggregate(products, F.lit(0.0), lambda total, v: total + v) + F.col("intercept")
    return scored.withColumn("score", score).select(
        group, key, F.col("label").alias("truth"), F.when(F.col("score") > 0, 1).otherwise(0).alias("pred"), "score"
    )
