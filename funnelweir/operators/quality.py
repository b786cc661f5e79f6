"""Data-contract checks as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelweir.operators.ordering import prefix_sums


def expect(df: DataFrame, checks: Mapping[str, Column], name: str = "table") -> DataFrame:
    """PASS / FAIL per row predicate with the number of violating rows, from one scan."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    long = counts.unpivot([], list(checks), "check_name", "violations")
    return long.select(
        F.lit(name).alias("table_name"),
        "check_name",
        "violations",
        F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"),
    )


def expect_totals(df: DataFrame, checks: Mapping[str, tuple[Column, Column]], name: str = "table") -> DataFrame:
    """PASS / FAIL per aggregate check: name -> (aggregate shown, aggregate condition)."""
    parts = []
    for k, (shown, condition) in checks.items():
        parts += [shown.cast("string").alias(f"{k}__d"), condition.alias(f"{k}__p")]
    row = df.agg(*parts)
    lines = [
        F.struct(
            F.lit(k).alias("check_name"),
            F.col(f"{k}__d").alias("detail"),
            F.when(F.coalesce(F.col(f"{k}__p"), F.lit(False)), "PASS").otherwise("FAIL").alias("status"),
        )
        for k in checks
    ]
    return row.select(F.lit(name).alias("table_name"), F.inline(F.array(*lines)))


def require_pass(checks: DataFrame) -> None:
    failed = [r["check_name"] for r in checks.filter("status <> 'PASS'").collect()]
    if failed:
        raise ValueError(f"failed checks: {failed}")


def occurrence_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]
) -> DataFrame:
    """One-to-one join of repeated keys by occurrence number.

    Occurrences are numbered by range-sorted prefix sums, so a key repeated
    any number of times is not gathered in one task. The orders must be total
    within a key.
    """

    def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
        counted = df.withColumn("_one", F.lit(1))
        return prefix_sums(counted, keys, order, {"_occurrence": "_one"}).drop("_one")

    return numbered(left, left_order).join(numbered(right, right_order), [*keys, "_occurrence"]).drop("_occurrence")


def row_count_check(joined: DataFrame, source: DataFrame) -> DataFrame:
    """Rows before and after, and whether they agree (one row)."""
    a = source.agg(F.count("*").alias("source_rows"))
    b = joined.agg(F.count("*").alias("joined_rows"))
    return a.crossJoin(F.broadcast(b)).withColumn("aligned", F.col("source_rows") == F.col("joined_rows"))
