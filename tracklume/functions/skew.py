"""Group-wise building blocks that stay balanced when one group is very large.

A plain window over ``(file, particle)`` sends a whole track to one task.  The functions below give the same
answers while splitting every group above ``HOT_ROWS`` rows:

* the list of hot groups has at most ``rows / HOT_ROWS`` entries, which is the size bound behind each broadcast here;
* a hot group is cut into blocks of ``BLOCK`` consecutive order values, and only one summary row per block is
  compared across blocks;
* statistics of a group are joined back to its rows by (group, block) or (group, salt).

When no group is hot the extra branches are empty and adaptive execution removes them at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 4_000_000
BLOCK = 65_536
MAX_PIECES = 16_384


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Keys of the groups with more than ``limit`` rows: at most ``rows / limit`` of them."""
    limit = HOT_ROWS if limit is None else limit
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > limit).select(*keys)


def with_blocks(
    df: DataFrame, keys: Sequence[str], order: str, limit: int | None = None, block: int | None = None
) -> DataFrame:
    """Add ``_hot`` and ``_block``: 0 for ordinary groups, ``floor(order / block)`` for hot ones."""
    block = BLOCK if block is None else block
    hot = F.broadcast(hot_groups(df, keys, limit).withColumn("_hot", F.lit(True)))
    return df.join(hot, list(keys), "left").withColumn(
        "_block", F.when(F.col("_hot"), F.floor(F.col(order) / F.lit(block))).otherwise(F.lit(0)).cast("long")
    )


def without_blocks(df: DataFrame) -> DataFrame:
    return df.drop("_hot", "_block")


def previous(
    blocked: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str, prefix: str = "prev_"
) -> DataFrame:
    """Add ``prev_<column>``: the value one row earlier in the group, in the order of ``order``.

    ``blocked`` comes from :func:`with_blocks`.  Inside a block this is ``lag``; the first row of a later block of a
    hot group takes the last row of the block before it.  ``order`` must be unique inside a group.
    """
    block_keys = [*keys, "_block"]
    packed = F.struct(*columns)
    here = blocked.withColumn("_before", F.lag(packed).over(Window.partitionBy(*block_keys).orderBy(order)))
    tails = blocked.where("_hot").groupBy(*block_keys).agg(F.max_by(packed, F.col(order)).alias("_tail"))
    carry = (
        tails.withColumn("_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_block")))
        .where(F.col("_carry").isNotNull())
        .select(*block_keys, "_carry")
    )
    before = F.coalesce(F.col("_before"), F.col("_carry"))
    joined = here.join(carry, block_keys, "left")
    return joined.select(
        *blocked.columns, *[before.getField(c.strip("`")).alias(prefix + c) for c in columns]
    )


def attach_to_blocks(blocked: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one-row-per-group ``stats`` to the rows of :func:`with_blocks`, co-partitioned on (group, block).

    ``stats`` must carry ``_lo`` and ``_hi``, the smallest and largest block of the group (see :func:`block_span`).
    """
    spread = stats.withColumn("_block", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    return blocked.join(spread, [*keys, "_block"])


def block_span() -> list[Column]:
    return [F.min("_block").alias("_lo"), F.max("_block").alias("_hi")]


def attach(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    size: str,
    spread_by: Sequence[str],
    limit: int | None = None,
    sizes: DataFrame | None = None,
    most: int | None = None,
) -> DataFrame:
    """Join one-row-per-group ``stats`` to ``rows``, salting only the groups above ``limit`` rows.

    ``size`` names the column of ``stats`` with the number of rows in the group; ``spread_by`` names the columns whose
    hash picks the salt of a row.  ``sizes`` is a cheaper table with the same sizes, where there is one.  ``most``: no group is larger;
    up to ``limit``, no list of large groups is made and sent.
    """
    limit = HOT_ROWS if limit is None else limit
    if most is not None and most <= limit:
        # the one salt is no constant, so that the rows are dealt by (keys, salt) and Spark can split a large partition
        whole = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(0))))
        return rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(1)).cast("int")).join(whole, [*keys, "_salt"]).drop("_salt")
    ways = F.ceil(F.col(size) / F.lit(limit)).cast("int")
    hot = (stats if sizes is None else sizes).where(F.col(size) > limit).select(*keys, ways.alias("_ways"))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_ways")), F.lit(0)).cast("int")
    left = rows.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", salt).drop("_ways")
    right = stats.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(size) > limit, ways - 1).otherwise(0)))
    )
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    name: str,
    limit: int | None = None,
) -> DataFrame:
    """Add the 0-based rank of a row in its group.

    ``block`` is an expression that never decreases along ``order``.  Groups above ``limit`` rows are ranked inside each
    (group, block), shifted by the number of rows in the earlier blocks, so only block counts are ever ordered across a
    whole large group.  Other groups are ranked in one piece.
    """
    block_keys = [*keys, "_step"]
    hot = F.broadcast(hot_groups(df, keys, limit).withColumn("_hot", F.lit(True)))
    blocked = df.join(hot, list(keys), "left").withColumn("_step", F.when(F.col("_hot"), block))
    earlier = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    start = (
        blocked.where("_hot")
        .groupBy(*block_keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*block_keys, F.sum("_n").over(earlier).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy(*block_keys).orderBy(*order)) - 1
    # ordinary groups have no block: nothing joins them and their rank is complete
    return (
        blocked.withColumn("_inside", inside)
        .join(start, block_keys, "left")
        .withColumn(name, F.coalesce(F.col("_start"), F.lit(0)) + F.col("_inside"))
        .select(*df.columns, name)
    )


def value_pieces(df: DataFrame, value: str, pieces: int) -> list[float]:
    """Split points that cut the values of a column into pieces of similar size: at most ``pieces`` numbers."""
    probabilities = [i / pieces for i in range(1, pieces)]
    cuts = df.approxQuantile(value, probabilities, 1.0 / (2 * pieces))
    return [float("-inf"), *sorted(set(cuts)), float("inf")]


def running_totals(
    df: DataFrame, value: str, measures: Sequence[str], keys: Sequence[str] = (), pieces: int | None = None
) -> DataFrame:
    """Sum ``measures`` per distinct ``value`` and add ``before_<m>``: the sum over the smaller values of the group.

    Equal values are merged before anything is ordered.  The order is then built from pieces of the value range, so no
    task sorts a whole column: pieces are compared by their totals only.  By default there are four pieces per shuffle
    partition of the session.
    """
    if pieces is None:
        pieces = max(16, min(MAX_PIECES, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    merged = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    cut = Bucketizer(splits=value_pieces(df, value, pieces), inputCol=value, outputCol="_piece")
    placed = cut.transform(merged).withColumn("_piece", F.col("_piece").cast("int"))
    piece_keys = [*keys, "_piece"]
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        earlier = Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*piece_keys)
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(*piece_keys, *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias("_start_" + m) for m in measures])
    )
    inside = Window.partitionBy(*piece_keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns(
        {"_local_" + m: F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures}
    )
    return local.join(starts, piece_keys).select(
        *keys,
        value,
        *measures,
        *[(F.col("_start_" + m) + F.col("_local_" + m)).alias("before_" + m) for m in measures],
    )


def band_join(
    queries: DataFrame,
    candidates: DataFrame,
    keys: Sequence[str],
    value: str,
    low: str,
    high: str,
    spread_by: str,
    bin_rows: int = 2048,
    limit: int | None = None,
) -> DataFrame:
    """Pairs of query and candidate with equal ``keys`` and ``value`` between ``low`` and ``high`` of the query.

    The value range of a key is cut into at least 64 bins, and into more as its candidates grow, so that a bin holds about
    ``bin_rows`` of them if they are spread evenly; a query visits only the bins its band touches, and a bin with more
    than ``limit`` candidates is split over several partitions.  ``keys`` must take few values (they number pivots or
    a constant): the two tables broadcast here have one row per key, and one per key and bin.
    """
    limit = HOT_ROWS if limit is None else limit
    bins = F.greatest(F.lit(64), F.ceil(F.count(F.lit(1)) / bin_rows)).cast("long").alias("_bins")
    span = F.broadcast(candidates.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"), bins))

    def bin_of(x: Column) -> Column:
        place = F.floor(F.try_divide(x - F.col("_min"), (F.col("_max") - F.col("_min")) / F.col("_bins")))
        return F.least(F.coalesce(place, F.lit(0)), F.col("_bins") - 1)

    placed = candidates.join(span, list(keys)).withColumn("_bin", bin_of(F.col(value))).drop("_min", "_max", "_bins")
    bin_keys = [*keys, "_bin"]
    ways = F.broadcast(
        placed.groupBy(*bin_keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(limit)).cast("int").alias("_ways"))
    )
    right = placed.join(ways, bin_keys).withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), F.col("_ways")).cast("int")
    ).drop("_ways")
    touched = F.sequence(bin_of(F.greatest(low, "_min")), bin_of(F.least(high, "_max")))
    left = (
        queries.join(span, list(keys))
        .where((F.col(low) <= F.col("_max")) & (F.col(high) >= F.col("_min")))
        .withColumn("_bin", F.explode(touched))
        .join(ways, bin_keys)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_ways") - 1)))
        .drop("_min", "_max", "_bins", "_ways")
    )
    return (
        left.join(right, [*bin_keys, "_salt"])
        .where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high)))
        .drop("_bin", "_salt")
    )
