"""Connected components as repeated joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.functions.skew import attach
from tracklume.sources.tables import discard, stored


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str = "node") -> DataFrame:
    """Smallest node of the component of every node: (keys, node, label).

    ``edges`` has columns ``a`` and ``b``.  A round takes the smallest label around a node and then follows labels to
    their own label, so paths shrink by half each time.  Rounds go on until nothing changes.  Every round is a written
    table, so lineage stays short and a lost executor costs one round at most; superseded rounds are deleted.  A label shared by very many nodes is salted.
    Only nodes with an edge take part in the rounds; the others are their own components.
    Labels and edges meet by merge joins: a written table of ids is many times larger in memory than its files, whose size would have it sent to the driver.
    """
    both = stored(
        edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))), "edges"
    )
    everyone = nodes.select(*keys, node).distinct()
    linked = both.select(*keys, F.col("a").alias(node))
    labels = stored(everyone.join(linked.hint("merge"), [*keys, node], "left_semi").withColumn("label", F.col(node)), "labels")
    before = labels
    while True:
        around = (
            both.join(labels.select(*keys, F.col(node).alias("b"), "label").hint("merge"), [*keys, "b"])
            .groupBy(*keys, F.col("a").alias(node))
            .agg(F.min("label").alias("_near"))
        )
        lowered = stored(
            labels.join(around.hint("merge"), [*keys, node], "left").select(
                *keys, node, F.col("label").alias("_old"), F.least("label", "_near").alias("label")
            ),
            "labels",
        )
        if lowered.where(F.col("label") != F.col("_old")).isEmpty():
            discard(both)
            found = lowered.select(*keys, node, "label").hint("merge")
            return everyone.join(found, [*keys, node], "left").select(*keys, node, F.coalesce("label", node).alias("label"))
        discard(before)
        before = lowered
        used = lowered.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_size"))
        up = lowered.select(*keys, F.col(node).alias("label"), F.col("label").alias("_up"))
        jumped = attach(lowered, used.join(up.hint("merge"), [*keys, "label"]).hint("merge"), [*keys, "label"], "_size", [node], sizes=used)
        labels = jumped.select(*keys, node, F.col("_up").alias("label"))
