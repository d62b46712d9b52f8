"""Descriptive statistics: quantiles, histograms, correlations, paired comparisons and bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklume.functions.scalars import ratio
from tracklume.functions.skew import attach, running_totals
from tracklume.operators.features import with_overall
from tracklume.operators.select import drop_missing, guide_filter, keep_first, prefixed
from tracklume.sources.tables import stored


def percentiles(df: DataFrame, column: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, long form: (by, q, value).

    The two order statistics next to each rank are looked up in running counts of distinct values, so no task holds
    the values of a whole column.
    """
    counted = running_totals(df.withColumn("_c", F.lit(1)), column, ["_c"], by)
    wanted = F.transform(
        F.array(*[F.lit(float(q)) for q in qs]),
        lambda q: F.struct(q.alias("q"), (q * (F.col("_n") - 1)).alias("at")),
    )
    totals = df.groupBy(*by).agg(F.count(column).alias("_n")).withColumn("_ranks", wanted)
    if by:
        rows = attach(counted, totals, by, "_n", [column])
    else:
        one = F.broadcast(totals.withColumn("_one", F.lit(1)))
        rows = counted.withColumn("_one", F.lit(1)).join(one, "_one")
    first, last = F.col("before__c"), F.col("before__c") + F.col("_c")
    near = F.filter("_ranks", lambda r: (first <= F.ceil(r["at"])) & (F.floor(r["at"]) < last))
    touched = rows.where(F.size(near) > 0).select(*by, column, "_c", "before__c", F.inline(near))

    def picked(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < last), F.col(column)))

    found = touched.groupBy(*by, "q", "at").agg(
        picked(F.floor("at")).alias("_a"), picked(F.ceil("at")).alias("_b")
    )
    share = F.col("at") - F.floor("at")
    return found.select(*by, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias("value"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins between the smallest and largest value; the last bin is closed."""
    rows = with_overall(
        df.where(F.col(column).isNotNull()), F.min(column).alias("_min"), F.max(column).alias("_max")
    )
    width = (F.col("_max") - F.col("_min")) / bins
    place = F.coalesce(F.floor(ratio(F.col(column) - F.col("_min"), width)), F.lit(0))
    return rows.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(column).alias("smallest"), F.max(column).alias("largest")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows where both are present; NULL for a constant column.

    A task turns its rows into one matrix of sums per pair (count, sums, products, of values less the column's mean), so
    what is shuffled is columns times columns rows a task, whatever the number of rows.
    """
    names = list(columns)
    doubles = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    middle = doubles.agg(*[F.coalesce(F.avg(f"c{i}"), F.lit(0.0)) for i in range(len(names))]).first()
    centre = np.asarray(list(middle), float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(names), len(names)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - centre
            here = ~np.isnan(x)
            x = np.where(here, x, 0.0)
            there = here.astype(float)
            total += np.stack([there.T @ there, x.T @ there, there.T @ x, x.T @ x, (x * x).T @ there, there.T @ (x * x)])
        i, j = np.divmod(np.arange(len(names) ** 2), max(1, len(names)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(t.ravel()) for t in total]], ["i", "j", "n", "x", "y", "xy", "xx", "yy"]
        )

    parts = doubles.mapInArrow(sums, "i int, j int, n double, x double, y double, xy double, xx double, yy double")
    moments = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xy", "xx", "yy")])
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    joint, own, other = n * F.col("xy") - x * y, n * F.col("xx") - x * x, n * F.col("yy") - y * y
    # a constant column leaves only rounding errors of its sums
    varies = (own > 1e-12 * n * F.col("xx")) & (other > 1e-12 * n * F.col("yy"))
    listed = F.array(*[F.lit(c) for c in names])
    r = F.when(varies, joint / (F.sqrt(own) * F.sqrt(other)))
    return moments.select(F.get(listed, F.col("i")).alias("a"), F.get(listed, F.col("j")).alias("b"), r.alias("r"))


def siblings(
    tracks: DataFrame, mask: str, values: Sequence[str], marked: str, other: str, guides=("1398", "1514"), before=40
) -> DataFrame:
    """Marked track and its sibling side by side per file.

    With several unmarked tracks in a file the one with the smallest particle is taken.  Rows with a missing value are
    left out.
    """
    picked = guide_filter(tracks, guides).where(F.col("time") < before)
    columns = ["file", "particle", *values]
    one = prefixed(keep_first(picked.where(F.col(mask) == 1).select(*columns), ["file"], "particle"), marked, ["file"])
    two = prefixed(keep_first(picked.where(F.col(mask) == 0).select(*columns), ["file"], "particle"), other, ["file"])
    return drop_missing(one.join(two, "file"))


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def _average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    counted = running_totals(df.withColumn("_c", F.lit(1)), column, ["_c"])
    return counted.select(column, (F.col("before__c") + (F.col("_c") + 1) / 2).alias(name), "_c")


def spearman(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Rank correlation with average ranks for ties, its t statistic and a two-sided p-value."""
    pairs = stored(df.select(key, a, b).dropna(), "pairs")  # read once per rank and for the sum
    ranked = attach(pairs, _average_ranks(pairs, a, "_ra"), [a], "_c", [key]).drop("_c")
    ranked = attach(ranked, _average_ranks(pairs, b, "_rb"), [b], "_c", [key]).drop("_c")
    one = ranked.agg(
        ratio(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb")).alias("rho"),
        F.count(F.lit(1)).alias("n"),
    )
    freedom = (F.col("n") - 2).cast("double")
    t = F.col("rho") * F.sqrt(ratio(freedom, 1 - F.col("rho") * F.col("rho")))
    return one.withColumn("t", F.when((freedom > 0) & (F.abs("rho") < 1), t)).withColumn(
        "p", two_sided_p(F.col("t"), freedom)
    )


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz's evaluation), for x below (a + 1) / (a + b + 2)."""
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    total, m, change = d, 0, 0.0
    while abs(change - 1) > 1e-16:
        m += 1
        for factor in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + factor * d) or tiny)
            c = (1 + factor / c) or tiny
            change = c * d
            total *= change
            if abs(change - 1) <= 1e-16:
                break
    return front * total


def student_p(t: float, freedom: float) -> float:
    """Two-sided p-value of Student's t."""
    x, y = freedom / (freedom + t * t), t * t / (freedom + t * t)
    if x < (freedom / 2 + 1) / (freedom / 2 + 2.5):
        return _beta_tail(x, freedom / 2, 0.5)
    return 1 - _beta_tail(y, 0.5, freedom / 2)


def two_sided_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of Student's t by the incomplete beta function; NULL without t.  For tables of test results, not of measurements."""
    return F.pandas_udf(
        lambda ts, vs: pd.Series([student_p(t, v) if t == t and v > 0 else None for t, v in zip(ts, vs, strict=True)], dtype="float64"), "double"
    )(t.cast("double"), freedom.cast("double"))


def before_after(df: DataFrame, value: str, until: int = 40) -> DataFrame:
    """Values before (time 0) and after (0 < time < ``until``) the change of medium, long form."""
    condition = F.when(F.col("time") == 0, "before").when((F.col("time") > 0) & (F.col("time") < until), "after")
    return df.select(*[c for c in df.columns if c in ("file", "particle")], condition.alias("condition"), value).where(
        F.col("condition").isNotNull()
    )


def _poisson_1(resolution: float = 2.0**-32) -> list[float]:
    """Cumulative probabilities of the Poisson distribution with mean 1, as far as a 32-bit hash can tell them from 1."""
    term, found = math.exp(-1), [math.exp(-1)]
    while 1 - found[-1] > resolution:
        term /= len(found)
        found.append(found[-1] + term)
    return found


POISSON_1 = _poisson_1()


def mean_difference(
    df: DataFrame, value: str, key: Sequence[str], replicates: int = 200, level: float = 0.95, seed: int = 11
) -> DataFrame:
    """Difference of the means of ``after`` and ``before`` with a bootstrap percentile interval.

    Each row gets a Poisson(1) weight per replicate from a hash of its key, which is the bootstrap for large samples.
    Weights are summed per (condition, replicate) before anything is shuffled.
    """
    rows = df.where(F.col(value).isNotNull())
    observed = rows.groupBy("condition").agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), *[F.col(k).cast("string") for k in key]))
    uniform = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    weight = sum((F.when(uniform >= p, 1).otherwise(0) for p in POISSON_1[1:]), F.when(uniform >= POISSON_1[0], 1).otherwise(0))
    resampled = (
        rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("_w", weight)
        .groupBy("condition", "replicate")
        .agg(ratio(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("_m"))
    )

    def side(name: str) -> Column:
        return F.max(F.when(F.col("condition") == name, F.col("_m")))

    gaps = resampled.groupBy("replicate").agg((side("after") - side("before")).alias("_d"))
    tail = (1 - level) / 2
    interval = gaps.agg(
        F.percentile("_d", F.lit(tail)).alias("low"), F.percentile("_d", F.lit(1 - tail)).alias("high")
    ).withColumn("_one", F.lit(1))
    point = observed.agg(
        (side("after") - side("before")).alias("difference"),
        F.sum(F.when(F.col("condition") == "before", F.col("_n"))).alias("n_before"),
        F.sum(F.when(F.col("condition") == "after", F.col("_n"))).alias("n_after"),
    ).withColumn("_one", F.lit(1))
    return point.join(interval, "_one").drop("_one")


def column_shares(df: DataFrame, by: str, bucket: Column) -> DataFrame:
    """Share of each bucket inside its condition."""
    counts = df.groupBy(by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("_all"))
    return counts.join(totals, by).select(by, "bucket", "n", ratio(F.col("n").cast("double"), F.col("_all")).alias("share"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def missing_counts(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Missing values per column and number of classes, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(label).alias("n_classes"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
    )


def density_2d(df: DataFrame, x: str, y: str, by: str, steps: int = 10) -> DataFrame:
    """Gaussian kernel density on a grid between the extremes, one density per group, with Scott's bandwidth.

    Every row meets every grid point, and the sums are formed before the shuffle; the grid has ``steps`` squared points.
    """
    rows = with_overall(
        df.select(by, x, y).dropna(),
        *[f(c).alias(f"_{n}_{c}") for c in (x, y) for f, n in ((F.min, "min"), (F.max, "max"))],
    )
    per_group = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp(x).alias("_sx"), F.stddev_samp(y).alias("_sy")
    )
    grid = F.sequence(F.lit(0), F.lit(steps - 1))
    # few groups (labels): one row each
    spread = (
        rows.join(F.broadcast(per_group), by)
        .withColumn("i", F.explode(grid))
        .withColumn("j", F.explode(grid))
    )

    def at(c: str, i: str) -> Column:
        return F.col(f"_min_{c}") + (F.col(f"_max_{c}") - F.col(f"_min_{c}")) * F.col(i) / (steps - 1)

    scale = F.pow(F.col("_n").cast("double"), F.lit(-1.0 / 6.0))
    hx, hy = F.col("_sx") * scale, F.col("_sy") * scale
    u, v = (F.col(x) - at(x, "i")) / hx, (F.col(y) - at(y, "j")) / hy
    kernel = F.exp(-(u * u + v * v) / 2) / (2 * F.pi() * hx * hy * F.col("_n"))
    return spread.groupBy(by, "i", "j").agg(F.sum(kernel).alias("density"))
