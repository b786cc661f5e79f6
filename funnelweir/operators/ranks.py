"""Rank-based scaling, levels and bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelweir.functions.hashing import hash_key
from funnelweir.functions.scalars import safe_double
from funnelweir.operators import ordering as O


def zero_preserving_rank(
    df: DataFrame, value: str, key: Sequence[str], out: str, seed=0, by: Sequence[str] = ()
) -> DataFrame:
    """Zeros stay 0; positives become rank / n, ties split by a seeded hash of ``key``.

    One range sort carries the rows along, so nothing is joined back.
    """
    x = F.coalesce(safe_double(value), F.lit(0.0))
    keyed = df.withColumns(
        {"_v": F.greatest(x, F.lit(0.0)), "_h": F.unhex(hash_key(seed, *key)), "_pos1": (x > 0).cast("int")}
    )
    order = ["_v", "_h", *key]
    if by:
        ranked = O.prefix_sums(keyed, by, order, {"_before": "_pos1"})
        sizes = ranked.groupBy(*by).agg(F.sum("_pos1").alias("_n"))
        sized = ranked.join(sizes, list(by), "left")
        rank = F.col("_before") + 1
    else:
        ranked = O.global_row_number(keyed, order, "_rn", ["_v", "_h"])
        sizes = ranked.agg(F.sum("_pos1").alias("_n"), F.count_if(F.col("_pos1") == 0).alias("_z"))
        sized = ranked.crossJoin(F.broadcast(sizes))
        rank = F.col("_rn") - F.col("_z")
    score = F.when(F.col("_pos1") == 1, rank / F.col("_n")).otherwise(F.lit(0.0))
    return sized.select(*by, *[c for c in df.columns if c not in by], score.alias(out))


def average_rank_share(df: DataFrame, value: str, out: str, by: Sequence[str] = (), positive: bool = True) -> DataFrame:
    """Average-rank percentile per group; with ``positive`` zeros stay 0 and are not ranked."""
    base = df.filter(F.col(value) > 0) if positive else df
    ranked = O.average_ranks(base, value, by)
    share = ranked.select(*by, value, (F.col("avg_rank") / F.col("n")).alias("_share"))
    joined = df.join(share, [*by, value], "left")
    result = F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.col("_share")) if positive else F.col("_share")
    return joined.withColumn(out, result).drop("_share")


def tertile_labels(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """low / mid / high by average-rank share; NULL with fewer than three distinct values."""
    ranked = O.average_ranks(df, value, by)
    distinct = ranked.groupBy(*by).agg(F.count("*").alias("_d"))
    sized = ranked.join(distinct, list(by)) if by else ranked.crossJoin(F.broadcast(distinct))
    share = F.col("avg_rank") / F.col("n")
    label = F.when(share <= 1 / 3, "low").when(share <= 2 / 3, "mid").otherwise("high")
    table = sized.select(*by, value, F.when(F.col("_d") >= 3, label).alias(out))
    return df.join(table, [*by, value], "left")


def history_cuts(train: DataFrame, column: str, probs: Sequence[float] = (1 / 3, 2 / 3)) -> list[float]:
    """Distinct quantile cuts of the positive training values (at most ``len(probs)`` numbers)."""
    x = safe_double(column, 0.0)
    cuts = O.quantile_scalars(train.select(x.alias("_x")).filter("_x > 0"), "_x", probs)
    return sorted({c for c in cuts if c is not None})


def history_level(column: str, cuts: Sequence[float]) -> Column:
    """0 for none; positives 1 + number of cuts reached (one cut: passed)."""
    x = safe_double(column, 0.0)
    if len(cuts) == 1:
        above = (x > cuts[0]).cast("int")
    else:
        above = sum(((x >= c).cast("int") for c in cuts), F.lit(0))
    return F.when(x > 0, F.least(F.lit(3), 1 + above)).otherwise(F.lit(0))


def empirical_cdf(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """name, value, share of observed rows at or below the value."""
    ids = [*by, "name"]
    counts = O.value_counts(O.melt(df, columns, by), "value", ids)
    running = O.prefix_sums(counts, ids, ["value"], {"_before": "_cnt"})
    totals = running.groupBy(*ids).agg(F.sum("_cnt").alias("_n"))
    return running.join(totals, ids).select(
        *ids, "value", ((F.col("_before") + F.col("_cnt")) / F.col("_n")).alias("cdf")
    )


def popularity_tiers(df: DataFrame, column: str, names: Sequence[str], probs=(0.33, 0.66)) -> DataFrame:
    """Tail / Mid / Top label by two quantiles of ``column`` over the table."""
    low, high = O.quantile_scalars(df, column, probs)
    x = F.col(column)
    label = F.when(x > F.lit(high), names[2]).when(x > F.lit(low), names[1]).otherwise(names[0])
    return df.withColumn("position", label)


def dense_ids(df: DataFrame, column: str, order: Sequence[str], out: str) -> DataFrame:
    """0-based dense ids in order of first appearance: column, out."""
    first = df.groupBy(column).agg(F.min(F.struct(*order)).alias("_first"))
    numbered = O.global_row_number(first, ["_first", column], out)
    return numbered.select(column, (F.col(out) - 1).alias(out))
