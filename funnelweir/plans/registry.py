"""Named queries and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0), so both engines print the same numbers."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles}) if doubles else df


def sql_rounded(body: str, plain: Sequence[str], doubles: Sequence[str], digits: int = DIGITS) -> str:
    """The same rounding around a SQL body whose last CTE or query is ``body``."""
    shown = [f'"{c}"' for c in plain]
    shown += [f'ROUND(CAST("{c}" AS DOUBLE), {digits}) + 0.0 AS "{c}"' for c in doubles]
    return f"SELECT {', '.join(shown)} FROM ({body.strip()})"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
