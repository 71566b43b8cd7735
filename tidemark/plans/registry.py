"""The catalogue of named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import measured_joins, table


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``build(t)``; ``t(name)`` loads a table of the data folder ``t.folder`` in the session ``t.spark``."""

    def wrap(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark = measured_joins(spark)

            def t(name: str) -> DataFrame:
                return table(spark, folder, name)

            t.spark, t.folder = spark, folder
            return build(t)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, covers, run, sql)
        return build

    return wrap


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """All double columns rounded, everything else unchanged."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return df.select(
        *[
            (F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(c)
            for c in df.columns
        ]
    )


def round_sql(inner: str, exact: list[str], doubles: list[str], digits: int = 9) -> str:
    """The SQL twin of ``rounded``: selects ``exact`` and rounds ``doubles``."""
    parts = [*exact, *[f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles]]
    return f"SELECT {', '.join(parts)} FROM ({inner}) AS answer"
