"""Column helpers: every one is a built-in expression, so it stays inside generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL where the denominator is zero or missing."""
    return F.try_divide(numerator, denominator)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere: NaN would poison sums and win every maximum."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def is_one_of(column: Column, values: Iterable) -> Column:
    """Membership that is false, not NULL, for a missing value, so that its negation keeps the row."""
    return F.coalesce(column.isin(list(values)), F.lit(False))


def step_length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def undirected_angle(dx: Column, dy: Column) -> Column:
    """Angle of the line through a step, in [-pi/2, pi/2]; a step of length zero has none."""
    vertical = F.when(dy > 0, F.lit(1.0)).when(dy < 0, F.lit(-1.0)) * (F.pi() / 2)
    return F.when(dx == 0, vertical).otherwise(F.atan(ratio(dy, dx)))


def wrapped(delta: Column) -> Column:
    """Bring a difference of two headings back into [-pi, pi]."""
    return (
        F.when(delta > F.pi(), delta - 2 * F.pi()).when(delta < -F.pi(), delta + 2 * F.pi()).otherwise(delta)
    )


def scalar_math(df: DataFrame, x: str, y: str) -> DataFrame:
    """The scalar functions used by the operators, side by side."""
    a, b = F.col(x), F.col(y)
    return df.select(
        "*",
        F.sqrt(F.abs(a)).alias("root"),
        F.pow(a, F.lit(2.0)).alias("square"),
        F.atan(a).alias("arc"),
        F.atan2(b, a).alias("direction"),
        F.radians(a).alias("radian"),
        F.abs(a - b).alias("gap"),
        F.when(a > b, F.lit(1)).otherwise(F.lit(0)).alias("above"),
        a.cast("int").alias("whole"),
    )


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Round every double so results compare across engines; ``other`` sets the digits of single columns.

    Sums in another order differ in the last bits, which matters when a value lies half way between two results.  So
    the noise is rounded away three digits further on first, and halves then go up by plain arithmetic.
    """
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}

    def settled(c: str) -> Column:
        places = other.get(c, digits)
        scale = float(10**places)
        half_up = F.floor(F.round(c, places + 3) * scale + 0.5) / scale
        # from 2 ** 52 units on, a double has no digits behind the last place
        large = F.when(F.abs(c) < float("inf"), F.col(c))
        return F.when(F.abs(c) < 2.0**52 / scale, half_up).otherwise(large).alias(c)

    return df.select(*[settled(c) if c in doubles else F.col(c) for c in df.columns])
