"""The registered queries over the star schema, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.sources.fixtures import Tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
_HELD: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    """The tables of a folder, once for each application, so that the daily fact is kept only once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Tables(spark, folder)
    return _HELD[key]


def forget() -> None:
    """Let go of the tables held for the last folder."""
    _HELD.clear()


#: Places that results are rounded to, so that both engines give the same figures; a hair decides ties.
PLACES, HAIR = 6, 1e-10


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded as DuckDB does: the product with a power of ten decides halves, not the shortest text of the number."""
    unit = 10.0**PLACES
    return df.select(*[(F.round((F.col(n) + HAIR) * unit) / unit).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def register(name: str, plan: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Register ``plan`` under ``name``; ``sql`` selects the same columns from the oracle's parts."""
    PLANS[name] = plan
    QUERIES[name] = lambda spark, folder: rounded(plan(tables(spark, folder)))
    if sql:
        from shelfspark.oracles.base import query
        from shelfspark.oracles.doubles import DOUBLES

        places = ", ".join(f"round({c} + {HAIR!r}, {PLACES}) AS {c}" for c in DOUBLES.get(name, "").split())
        ORACLES[name] = f"SELECT *{f' REPLACE ({places})' if places else ''} FROM ({query(sql)})"
