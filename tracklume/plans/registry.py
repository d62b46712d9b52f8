"""Names of the queries, the functions behind them, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def settled(column: str, digits: int = 6) -> str:
    """SQL of a double as ``scalars.rounded`` gives it, infinities and NaN as NULL."""
    value = f"CAST({column} AS DOUBLE)"
    half_up = f"floor(round({value}, {digits + 3}) * 1e{digits} + 0.5) / 1e{digits}"
    return (
        f"CASE WHEN isnan({value}) OR isinf({value}) THEN NULL WHEN abs({value}) >= {2.0**52 / 10**digits!r} THEN {value} ELSE {half_up} END"
    )


def twin(sql: str, keep: Sequence[str], doubles: Sequence[str], digits: int = 6, **other: int) -> str:
    """Final projection of a twin: doubles rounded as in ``scalars.rounded``, infinities and NaN as NULL."""
    plain = [f"q.{c}" for c in keep]
    cleaned = [f"{settled(f'q.{c}', other.get(c, digits))} AS {c}" for c in doubles]
    return f"SELECT {', '.join(plain + cleaned)} FROM ({sql}) q"
