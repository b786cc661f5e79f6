"""Click / cart / purchase event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelweir.functions import scalars as S

STAGES = ("click", "cart", "purchase")
KEYS = ("user_id", "item_id", "timestamp")
# fixed value: position of an event without a recorded one
DEFAULT_POSITION = "trans_direct"


def flag(name: str) -> Column:
    return F.coalesce(S.as_double(name), F.lit(0.0)).cast("int")


def close_funnel(df: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """A later stage implies every earlier one."""
    columns = [f"y_{s}" for s in stages]
    closed = {c: F.greatest(*[flag(x) for x in columns[i:]]) for i, c in enumerate(columns[:-1])}
    return df.withColumns({**closed, columns[-1]: flag(columns[-1])})


def collapse_duplicates(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key: highest flags, smallest non-default position."""
    named = F.when(F.col("position") != DEFAULT_POSITION, F.col("position"))
    return df.groupBy(*keys).agg(
        *[F.max(f"y_{s}").alias(f"y_{s}") for s in STAGES],
        F.coalesce(F.min(named), F.lit(DEFAULT_POSITION)).alias("position"),
    )


def merge_logs(clicks: DataFrame, orders: DataFrame) -> DataFrame:
    """Full outer join of the click log and the cart/purchase log, cleaned and closed."""
    joined = clicks.join(orders, list(KEYS), "full_outer").withColumn(
        "position", F.coalesce("position", F.lit(DEFAULT_POSITION))
    )
    cleaned = joined.withColumns(
        {
            "user_id": S.clean_id("user_id"),
            "item_id": S.clean_item_id("item_id"),
            "timestamp": S.as_double("timestamp"),
        }
    ).dropna(subset=list(KEYS))
    # closure is monotone in the flags, so one closure after the maximum is enough
    return close_funnel(collapse_duplicates(close_funnel(cleaned)))


def diagnostics(df: DataFrame) -> DataFrame:
    """Metric/value rows: violations, sizes, stage totals and flag patterns."""
    click, cart, purchase = (F.col(f"y_{s}") == 1 for s in STAGES)
    pattern = F.concat(
        F.lit("pattern_"), F.concat_ws("_", *[F.concat(F.lit(s), F.col(f"y_{s}").cast("string")) for s in STAGES])
    )
    one_row = df.agg(
        F.count_if(purchase & ~cart).alias("purchase_without_cart"),
        F.count_if(cart & ~click).alias("cart_without_click"),
        F.count_if(purchase & ~click).alias("purchase_without_click"),
        F.count("*").alias("n_rows"),
        *[F.coalesce(F.sum(f"y_{s}"), F.lit(0)).cast("bigint").alias(f"n_{s}") for s in STAGES],
    )
    # distinct counts in their own jobs: no row multiplication for several distincts
    users = df.agg(F.countDistinct("user_id").alias("n_users"))
    items = df.agg(F.countDistinct("item_id").alias("n_items"))
    wide = one_row.crossJoin(F.broadcast(users)).crossJoin(F.broadcast(items))
    metrics = wide.unpivot([], wide.columns, "metric", "value")
    patterns = df.groupBy(pattern.alias("metric")).agg(F.count("*").alias("value"))
    return metrics.unionByName(patterns)


def purchase_diagnostics(df: DataFrame) -> DataFrame:
    wide = (
        df.agg(
            F.count("*").alias("rows"),
            F.sum("y_purchase").cast("bigint").alias("purchase_positive_records"),
            F.sum("is_sampled_nonpurchase").cast("bigint").alias("sampled_nonpurchase_records"),
            F.lit(0).cast("bigint").alias("native_click_available"),
            F.lit(0).cast("bigint").alias("native_cart_available"),
        )
        .crossJoin(F.broadcast(df.agg(F.countDistinct("user_id").alias("users"))))
        .crossJoin(F.broadcast(df.agg(F.countDistinct("item_id").alias("items"))))
    )
    return wide.unpivot([], wide.columns, "metric", "value")


def merge_sources(positives: DataFrame, sampled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Union of observed and sampled rows: highest label, other columns from the first source having them."""
    rest = [c for c in positives.columns if c not in (*keys, "y_purchase", "is_sampled_nonpurchase")]
    both = positives.withColumn("_rank", F.lit(0)).unionByName(
        sampled.withColumn("_rank", F.lit(1)), allowMissingColumns=True
    )
    # rows of equal rank are ordered by value, so the pick does not depend on task order
    first = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col("_rank"), F.col(c)))).alias(c) for c in rest
    ]
    return both.groupBy(*keys).agg(
        F.max("y_purchase").alias("y_purchase"),
        F.max("is_sampled_nonpurchase").alias("is_sampled_nonpurchase"),
        *first,
    )


def interaction_edges(df: DataFrame, stage: str, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Distinct positive (user, item) pairs of one stage."""
    return df.filter(flag(f"y_{stage}") == 1).select(user, item).distinct()
