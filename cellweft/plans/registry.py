"""Named queries over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a function under its name, with its SQL."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to 6 places; no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0).cast("double")


def R(expr: str, name: str = "v") -> str:  # noqa: N802
    """The same in DuckDB."""
    return f"round(({expr})::DOUBLE, 6) + 0.0::DOUBLE AS {name}"


def long(df: DataFrame, *keys: str, bits: str = "bits") -> DataFrame:
    """One row a feature: keys, bit, v."""
    return df.select(*keys, F.posexplode(bits).alias("bit", "v")).withColumn("v", r6("v"))
