"""Smallest node of each connected component, for links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklume.functions.skew import attach
from tracklume.sources.tables import discard, stored


def _to_least(rows: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``least`` of ``a`` on every row, by a merge join: small tables sent to every task in round after round would pile up on the driver."""
    return attach(rows, least.hint("merge"), ["a"], "n", ["b"], most=most)


def _large_star(pairs: DataFrame, most: int) -> DataFrame:
    """Every neighbour larger than a node moves to the smallest node around it."""
    both = pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _to_least(both.where(F.col("b") > F.col("a")), least, most).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(pairs: DataFrame, most: int) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _to_least(down, least, most).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _only_stars(pairs: DataFrame) -> tuple[bool, int]:
    """Whether every node of ``a`` has that one link and no other, and the number of links."""
    ends = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    found = nodes.agg(F.sum("up").alias("links"), F.max(F.when(F.col("up") > 0, F.col("n"))).alias("most")).first()
    return (found.most or 1) == 1, found.links or 0


def smallest_of_component(pairs: DataFrame) -> DataFrame:
    """For columns ``a`` and ``b`` of links: every linked node that is not its component's smallest, and that node, as ``node``, ``label``.

    Alternating large and small stars (Kiveris and others, 2014) until each component is one star around its smallest node, which neither changes.  Their number of rounds
    grows with the logarithm of the longest path; no round is larger than the list of links.  Each star is a written
    table, which replaces the one before.  The links of a node with millions of them are salted.
    """
    now = stored(pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    done, most = _only_stars(now)  # no node has more links than there are; a star never adds any
    while not done:
        for star in (_large_star, _small_star):
            before, now = now, stored(star(now, most), "links")
            discard(before)
        done, most = _only_stars(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
