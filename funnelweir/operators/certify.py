"""Temporal certification of item measurements and its effect on the analysis sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.functions.scalars import is_true_text, safe_double
from funnelweir.functions.text import first_unique_texts
from funnelweir.operators.ordering import exact_quantiles, melt

CERTIFIED = "CERTIFIED_PRE_SET_C"
FAILED = "FAIL_POST_OR_AT_SET_C_REVIEW"


def audit_items(reviews: DataFrame, set_c: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Item certification and violating reviews.

    An item passes if its first ``k`` distinct review texts (stored order) all
    predate its first evaluation event. Items without reviews pass.
    """
    first = set_c.groupBy("item_id").agg(F.min("timestamp").alias("item_first_set_c_timestamp"))
    wanted = reviews.join(first.select("item_id"), "item_id", "left_semi")
    chosen = first_unique_texts(wanted, k, with_text=False).join(first, "item_id")
    parsed = F.col("timestamp").isNotNull()
    early = F.coalesce(F.col("timestamp") < F.col("item_first_set_c_timestamp"), F.lit(False))
    chosen = chosen.withColumns({"timestamp_parse_ok": parsed, "strictly_pre_set_c": early})
    audit = chosen.groupBy("item_id").agg(
        F.count("*").alias("selected_review_rows"),
        F.min("timestamp").alias("min_selected_review_timestamp"),
        F.max("timestamp").alias("max_selected_review_timestamp"),
        F.bool_and("timestamp_parse_ok").alias("timestamp_parse_ok"),
        F.bool_and("strictly_pre_set_c").alias("strictly_pre_set_c"),
    )
    items = first.join(audit, "item_id", "left").withColumns(
        {
            "selected_review_rows": F.coalesce("selected_review_rows", F.lit(0)),
            "timestamp_parse_ok": F.coalesce("timestamp_parse_ok", F.lit(True)),
            "strictly_pre_set_c": F.coalesce("strictly_pre_set_c", F.lit(True)),
        }
    )
    items = items.withColumns(
        {
            "input_mode": F.when(F.col("selected_review_rows") == 0, "metadata_image_only").otherwise(
                "metadata_image_plus_reviews"
            ),
            "certification_status": F.when(F.col("strictly_pre_set_c"), CERTIFIED).otherwise(FAILED),
        }
    )
    violations = chosen.filter(~F.col("strictly_pre_set_c")).select(
        "item_id",
        "user_id",
        F.col("timestamp").alias("review_timestamp"),
        "item_first_set_c_timestamp",
        "timestamp_parse_ok",
    )
    return items, violations


def audit_summary(items: DataFrame, set_c: DataFrame) -> DataFrame:
    """Item and row certification rates (one row)."""
    ok = F.col("strictly_pre_set_c")
    by_item = items.agg(
        F.count("*").alias("set_c_items"),
        F.count_if(F.col("selected_review_rows") > 0).alias("items_with_selected_reviews"),
        F.count_if(ok).alias("items_certified"),
        F.count_if(~ok).alias("items_failed"),
        F.sum("selected_review_rows").alias("selected_review_rows"),
        F.avg(ok.cast("double")).alias("item_certification_rate"),
    )
    rows = set_c.join(items.select("item_id", "strictly_pre_set_c"), "item_id", "left").agg(
        F.count("*").alias("set_c_rows"),
        F.min("timestamp").alias("set_c_start_timestamp"),
        F.count_if(ok).alias("certified_rows"),
        F.avg(F.coalesce(ok, F.lit(False)).cast("double")).alias("row_certification_rate"),
    )
    status = F.when(F.col("items_failed") == 0, "PASS").otherwise("FAIL")
    return by_item.crossJoin(F.broadcast(rows)).withColumn("audit_status", status)


def certification_contract(items: DataFrame) -> DataFrame:
    """Missing or repeated ids and disagreement of status text and flag (one row)."""
    flag = is_true_text(F.col("strictly_pre_set_c"))
    status = F.coalesce(F.col("certification_status") == CERTIFIED, F.lit(False))
    per_item = items.groupBy("item_id").agg(
        F.count("*").alias("_n"),
        F.count_if(flag != status).alias("_disagree"),
        F.count_if(flag & status).alias("_ok"),
    )
    table = per_item.agg(
        F.sum("_n").alias("rows"),
        F.count_if(F.coalesce(F.col("item_id"), F.lit("")) == "").alias("missing_ids"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_ids"),
        F.sum("_disagree").alias("disagreements"),
        F.sum("_ok").alias("certified_items"),
    )
    broken = F.col("missing_ids") + F.col("duplicate_ids") + F.col("disagreements")
    return table.withColumn("valid", (broken == 0) & (F.col("certified_items") > 0))


def certified_items(items: DataFrame) -> DataFrame:
    keep = is_true_text(F.col("strictly_pre_set_c")) & (F.col("certification_status") == CERTIFIED)
    return items.filter(keep).select("item_id")


def restrict(df: DataFrame, items: DataFrame) -> DataFrame:
    """Rows on certified items; column pruning and the size of ``items`` decide the join."""
    return df.join(certified_items(items), "item_id", "left_semi")


def mark_certified(df: DataFrame, items: DataFrame, out: str = "certified") -> DataFrame:
    tagged = certified_items(items).withColumn(out, F.lit(True))
    return df.join(tagged, "item_id", "left").withColumn(out, F.coalesce(out, F.lit(False)))


def retention(df: DataFrame, items: DataFrame, split: str, outcomes: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Before and after figures per split from one conditional aggregate."""
    marked = mark_certified(df, items)
    kept = F.col("certified")
    # item counts come from (split, item) pairs, not from several distincts at once
    pairs = marked.groupBy(split, "item_id").agg(F.max("certified").alias("_k"))
    item_counts = pairs.groupBy(split).agg(
        F.count("*").alias("items_before"), F.count_if("_k").alias("items_after")
    )
    rates = []
    for y in outcomes:
        rates += [F.avg(y).alias(f"{y}_rate_before"), F.avg(F.when(kept, F.col(y))).alias(f"{y}_rate_after")]
    rows = marked.groupBy(split).agg(
        F.count("*").alias("rows_before"),
        F.count_if(kept).alias("rows_after"),
        F.count_if(~kept).alias("rows_removed"),
        F.avg(kept.cast("double")).alias("row_retention_rate"),
        F.min(F.when(kept, F.col(ts))).alias("min_timestamp_after"),
        F.max(F.when(kept, F.col(ts))).alias("max_timestamp_after"),
        *rates,
    )
    return rows.join(item_counts, split)


def balance(df: DataFrame, columns: Sequence[str], flag: str = "certified") -> DataFrame:
    """Standardised mean difference between certified and other rows, per column."""
    long = melt(df.withColumns({c: safe_double(c) for c in columns}), columns, [flag], "column_name")
    side = {"certified": F.col(flag), "failed": ~F.col(flag)}
    stats = []
    for name, here in side.items():
        x = F.when(here, F.col("value"))
        stats += [
            F.count(x).alias(f"{name}_n"),
            F.avg(x).alias(f"{name}_mean"),
            F.coalesce(F.stddev(x), F.lit(0.0)).alias(f"{name}_sd"),
        ]
    table = long.groupBy("column_name").agg(*stats).filter("certified_n + failed_n > 0")
    pooled = F.sqrt((F.pow("certified_sd", F.lit(2)) + F.pow("failed_sd", F.lit(2))) / 2)
    gap = F.col("certified_mean") - F.col("failed_mean")
    return table.withColumn("standardized_mean_difference", F.when(pooled > 0, F.try_divide(gap, pooled)))


def weighted_balance(
    df: DataFrame, columns: Sequence[str], probability: str, flag: str = "certified", trim: float = 0.99
) -> tuple[DataFrame, DataFrame]:
    """Balance of inverse-probability weighted certified rows against all rows, and weight figures."""
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col(probability)))
    work = df.withColumns({c: safe_double(c) for c in columns}).withColumn("_w", F.when(F.col(flag), 1.0 / p))
    cap = exact_quantiles(work, ["_w"], [trim]).first()["p0"]
    # rows outside the certified sample have no weight; least() alone would give them the cap
    work = work.withColumn("_w", F.when(F.col("_w").isNotNull(), F.least(F.col("_w"), F.lit(float(cap)))))
    mean = work.agg(F.avg("_w")).first()[0]
    work = work.withColumn("_w", F.col("_w") / F.lit(float(mean)))
    long = melt(work, columns, [flag, "_w"], "column_name").filter(F.col("value").isNotNull())
    inside = F.col(flag)
    x, w = F.col("value"), F.col("_w")
    table = long.groupBy("column_name").agg(
        F.count("*").alias("full_n"),
        F.count_if(inside).alias("certified_n"),
        F.avg(x).alias("full_mean"),
        F.coalesce(F.stddev(x), F.lit(0.0)).alias("full_sd"),
        F.avg(F.when(inside, x)).alias("certified_mean"),
        F.try_divide(F.sum(F.when(inside, x * w)), F.sum(F.when(inside, w))).alias("weighted_mean"),
    ).filter("certified_n > 0")
    sd = F.when(F.col("full_sd") > 0, F.col("full_sd"))
    table = table.withColumns(
        {
            "unweighted_smd": F.try_divide(F.col("certified_mean") - F.col("full_mean"), sd),
            "weighted_smd": F.try_divide(F.col("weighted_mean") - F.col("full_mean"), sd),
        }
    ).drop("full_sd")
    common = (F.col(probability) >= 0.01) & (F.col(probability) <= 0.99)
    weights = work.agg(
        F.count("_w").alias("certified_rows"),
        F.avg("_w").alias("weight_mean"),
        F.lit(float(cap)).alias("weight_cap"),
        F.max("_w").alias("weight_max"),
        F.try_divide(F.pow(F.sum("_w"), F.lit(2)), F.sum(w * w)).alias("effective_sample_size"),
        F.avg(common.cast("double")).alias("common_support_rate"),
    )
    return table, weights
