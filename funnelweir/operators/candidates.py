"""Warm-start evaluation candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.functions.hashing import hash_key
from funnelweir.operators.funnel import STAGES, flag, interaction_edges
from funnelweir.operators.sampling import named_places, unseen_places

USER, ITEM = "user_id", "item_id"


def seen_items(*frames: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Distinct (user, item) with any positive stage in any frame."""
    merged = None
    for frame in frames:
        touched = F.lit(False)
        for s in stages:
            touched = touched | (flag(f"y_{s}") > 0)
        part = frame.filter(touched).select(USER, ITEM)
        merged = part if merged is None else merged.unionByName(part)
    return merged.distinct()


def latest_targets(train: DataFrame, test: DataFrame, stage: str) -> DataFrame:
    """Each warm user's latest test positive whose item is also known at this stage: user, item."""
    edges = interaction_edges(train, stage)
    positive = test.filter(flag(f"y_{stage}") == 1).select(USER, ITEM, "timestamp")
    warm = positive.join(edges.select(USER).distinct(), USER, "left_semi").join(
        edges.select(ITEM).distinct(), ITEM, "left_semi"
    )
    return warm.groupBy(USER).agg(F.max_by(ITEM, F.struct("timestamp", ITEM)).alias(ITEM))


def stage_candidates(
    train: DataFrame, test: DataFrame, stage: str, negatives: int, seed, max_users: int = 0
) -> DataFrame:
    """One target and ``negatives`` unseen warm items per user: stage, user, item, is_target.

    ``max_users`` limits the evaluation to a seeded uniform sample of users.
    """
    targets = latest_targets(train, test, stage)
    if max_users > 0:
        targets = targets.orderBy(hash_key(seed, USER), USER).limit(max_users)
    pool = interaction_edges(train, stage).select(ITEM).distinct()
    seen = seen_items(train, test).unionByName(targets.select(USER, ITEM))
    places, indexed = unseen_places(targets, USER, pool, ITEM, seen, negatives, f"{seed}|{stage}")
    kept = targets.join(places.select(USER).distinct(), USER, "left_semi")
    return (
        named_places(places, USER, indexed, ITEM).select(USER, ITEM, F.lit(False).alias("is_target"))
        .unionByName(kept.select(USER, ITEM, F.lit(True).alias("is_target")))
        .select(F.lit(stage).alias("stage"), USER, ITEM, "is_target")
    )


def candidate_metadata(train: DataFrame, test: DataFrame, stage: str, candidates: DataFrame) -> DataFrame:
    """Warm, eligible and excluded user counts of one stage (one row)."""
    edges = interaction_edges(train, stage)
    test_users = test.filter(flag(f"y_{stage}") == 1).select(USER).distinct()
    known = test_users.join(edges.select(USER).distinct(), USER, "left_semi")
    targets = latest_targets(train, test, stage)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        count(test_users, "positive_test_users"),
        count(targets, "stage_warm_start_eligible_users"),
        count(test_users.join(known, USER, "left_anti"), "excluded_no_prior_stage_interaction"),
        count(known.join(targets, USER, "left_anti"), "excluded_no_stage_warm_target"),
        count(candidates.select(USER).distinct(), "evaluated_users"),
        count(edges.select(USER).distinct(), "stage_train_users"),
        count(edges.select(ITEM).distinct(), "stage_train_items"),
        count(edges, "stage_train_edges"),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(F.broadcast(part))
    return row.select(F.lit(stage).alias("stage"), "*")


def candidate_contract(candidates: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Sizes, unknown ids and duplicate lists of a candidate table (one row)."""
    tagged = candidates.join(users.select(USER).distinct().withColumn("_u", F.lit(1)), USER, "left").join(
        items.select(ITEM).distinct().withColumn("_i", F.lit(1)), ITEM, "left"
    )
    per_item = tagged.groupBy("stage", USER, ITEM).agg(
        F.count("*").alias("_n"), F.max("_u").alias("_u"), F.max("_i").alias("_i")
    )
    per_user = per_item.groupBy("stage", USER).agg(
        F.sum("_n").alias("_size"),
        F.max(F.col("_u").isNull().cast("int")).alias("_bad_user"),
        F.sum(F.when(F.col("_i").isNull(), F.col("_n")).otherwise(0)).alias("_bad_items"),
        F.max((F.col("_n") > 1).cast("int")).alias("_dup"),
    )
    return per_user.groupBy("stage").agg(
        F.count("*").alias("users"),
        F.min("_size").alias("candidate_size_min"),
        F.max("_size").alias("candidate_size_max"),
        F.sum("_bad_user").alias("invalid_user_ids"),
        F.sum("_bad_items").alias("invalid_item_ids"),
        F.sum("_dup").alias("duplicate_candidate_lists"),
    )


def split_contract(df: DataFrame, split: str, ts: str = "timestamp", label: str = "y_purchase") -> DataFrame:
    return df.groupBy(split).agg(
        F.count("*").alias("rows"),
        F.countDistinct(USER).alias("unique_users"),
        F.countDistinct(ITEM).alias("unique_items"),
        F.count_if(flag(label) == 1).alias("purchase_positive_rows"),
        F.count_if(flag(label) == 0).alias("purchase_negative_rows"),
        F.min(ts).alias("timestamp_min"),
        F.max(ts).alias("timestamp_max"),
    )
