"""Registry of the library's queries, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Doubles are compared after rounding to so many places.
PLACES = 6


def finished(df: DataFrame) -> DataFrame:
    """Doubles rounded, NaN as NULL, whole numbers as bigint."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(F.nanvl(c.cast("double"), F.lit(None)), PLACES) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: str = "", longs: str = ""):
    """Registers a query; doubles and longs: the SQL's columns to round or cast likewise."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: finished(f(spark, sf_dir))
        if sql is not None:
            cast = [f"round(CAST({c} AS DOUBLE), {PLACES}) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
            SQL[name] = f"SELECT * REPLACE ({', '.join(cast)}) FROM ({sql})" if cast else sql
        return f

    return put
