"""Time-ordered splits without shared boundary timestamps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelweir.functions.hashing import hash_key
from funnelweir.operators.ordering import prefix_sums


def _time_table(df: DataFrame, ts: str) -> DataFrame:
    counts = df.groupBy(ts).agg(F.count("*").alias("_cnt"))
    return prefix_sums(counts, [], [ts], {"_before": "_cnt"})


def _row_at(table: DataFrame, ts: str, position: int):
    """(timestamp, rows up to and including it) for the 1-based row ``position``."""
    end = F.col("_before") + F.col("_cnt")
    hit = table.filter((F.col("_before") < position) & (end >= position)).select(ts, end.alias("_end")).first()
    return (None, None) if hit is None else (hit[ts], hit["_end"])


def abc_boundaries(df: DataFrame, ts: str, ratios: Sequence[float] = (0.2, 0.4, 0.4)):
    """Last timestamp of A and of B. Rows sharing a timestamp never part."""
    table = _time_table(df, ts)
    n = table.agg(F.sum("_cnt")).first()[0] or 0
    if n == 0:
        return None, None
    a = min(max(math.floor(n * ratios[0]), 1), max(n - 1, 1))
    last_a, size_a = _row_at(table, ts, a)
    b = min(max(math.floor(n * (ratios[0] + ratios[1])), a + 1), n - 1)
    last_b, _ = _row_at(table, ts, max(b, size_a + 1))
    return last_a, last_b


def abc_label(ts: str, last_a, last_b) -> Column:
    label = F.when(F.col(ts) <= F.lit(last_a), "A")
    if last_b is None:
        return label
    return label.when(F.col(ts) <= F.lit(last_b), "B").otherwise("C")


def temporal_split(df: DataFrame, ts: str, ratios=(0.2, 0.4, 0.4), out: str = "split") -> DataFrame:
    return df.withColumn(out, abc_label(ts, *abc_boundaries(df, ts, ratios)))


def two_way_boundary(df: DataFrame, ts: str, first_share: float):
    """Last timestamp of the first part; the boundary time goes to the first part unless that empties the second.

    Raises if all rows share one timestamp, as no boundary then leaves both parts rows.
    """
    table = _time_table(df, ts)
    n = table.agg(F.sum("_cnt")).first()[0] or 0
    if n == 0:
        return None
    cut = min(max(math.floor(n * first_share), 1), max(n - 1, 1))
    boundary = _row_at(table, ts, cut)[0]
    if table.filter(F.col(ts) > F.lit(boundary)).isEmpty():
        boundary = table.filter(F.col(ts) < F.lit(boundary)).agg(F.max(ts)).first()[0]
        if boundary is None:
            raise ValueError(f"all rows share one value of {ts}: they cannot be split in time")
    return boundary


def train_validation(df: DataFrame, ts: str, validation_fraction: float, out: str = "part") -> DataFrame:
    boundary = two_way_boundary(df, ts, 1.0 - validation_fraction)
    return df.withColumn(out, F.when(F.col(ts) <= F.lit(boundary), "train").otherwise("validation"))


def item_disjoint_split(
    df: DataFrame, item: str, label: str, test_share: float, seed, out: str = "part"
) -> DataFrame:
    """Whole items to train or test, stratified by the item's label, by hash order within a stratum."""
    items = df.groupBy(item).agg(F.max(label).alias(label))
    keyed = items.withColumn("_h", hash_key(seed, item)).withColumn("_one", F.lit(1))
    ranked = prefix_sums(keyed, [label], ["_h", item], {"_before": "_one"})
    sizes = items.groupBy(label).agg(F.count("*").alias("_n"))
    part = F.when(F.col("_before") < F.round(F.col("_n") * test_share), "test").otherwise("train")
    parts = ranked.join(F.broadcast(sizes), label).select(item, part.alias(out))
    return df.join(parts, item)


def split_summary(df: DataFrame, split: str, ts: str, means: dict[str, str]) -> DataFrame:
    """Rows, time range and column means per split plus an ``All`` row."""
    summary = df.rollup(split).agg(
        F.count("*").alias("rows"),
        F.min(ts).alias("min_timestamp"),
        F.max(ts).alias("max_timestamp"),
        *[F.avg(c).alias(o) for o, c in means.items()],
    )
    return summary.withColumn(split, F.coalesce(split, F.lit("All")))
