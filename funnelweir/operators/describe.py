"""Dimension tables, popularity, graph inputs and dataset statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelweir.functions.scalars import safe_double
from funnelweir.operators.funnel import STAGES
from funnelweir.operators.ordering import BROADCAST_ROWS, exact_quantiles, global_row_number, prefix_sums
from funnelweir.session import cut

# fixed value: year tenure is counted to
TENURE_YEAR = 2025
SLOTS = 5


def z_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Population z-scores from a one-row aggregate."""
    stats = df.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    wide = df.crossJoin(F.broadcast(stats))
    z = {}
    for c in columns:
        sd = F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
        z[f"{c}{suffix}"] = (F.col(c) - F.col(f"_m_{c}")) / sd
    return wide.withColumns(z).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def user_review_profile(reviews: DataFrame) -> DataFrame:
    """Review count and mean rating per user with z-scores."""
    usable = reviews.filter((F.col("user_id") != "") & F.col("rating").isNotNull())
    agg = usable.groupBy("user_id").agg(
        F.count("rating").cast("double").alias("user_review_count"), F.avg("rating").alias("user_avg_rating")
    )
    return z_scale(agg, ["user_review_count", "user_avg_rating"])


def user_tenure(users: DataFrame, year: str = "reg_year") -> DataFrame:
    """Years since registration, median filled, z-scaled."""
    tenure = users.withColumn("user_tenure", F.lit(float(TENURE_YEAR)) - safe_double(year))
    median = exact_quantiles(tenure, ["user_tenure"], [0.5]).select(F.col("p0").alias("_median"))
    filled = tenure.crossJoin(F.broadcast(median)).withColumn("user_tenure", F.coalesce("user_tenure", "_median"))
    return z_scale(filled.drop("_median"), ["user_tenure"])


def one_hot(df: DataFrame, categories: Mapping[str, Sequence[str]], unknown: str = "Unknown") -> DataFrame:
    """0/1 column per given category, named ``<column>_<value>``; missing reads as ``unknown``.

    The columns of the result follow from ``categories`` alone, never from the data's size.
    A value that is not listed has 0 everywhere; :func:`one_hot_long` needs no list.
    """
    clean = df.withColumns({c: filled_category(c, unknown) for c in categories})
    return clean.withColumns({f"{c}_{v}": F.coalesce(F.col(c) == v, F.lit(False)).cast("int") for c, values in categories.items() for v in sorted(values)})


def one_hot_long(df: DataFrame, key: str, columns: Sequence[str], unknown: str = "Unknown") -> DataFrame:
    """(key, column, value) of every 1 that :func:`one_hot` would hold, for any number of categories."""
    ones = F.array(*[F.struct(F.lit(c).alias("column"), filled_category(c, unknown).alias("value")) for c in columns])
    return df.select(key, F.explode(ones).alias("one")).select(key, "one.column", "one.value")


def filled_category(column: str, unknown: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(unknown)))


def median_impute(df: DataFrame, value: str, group: str) -> DataFrame:
    """Missing values from the group's median, then from the overall median."""
    by_group = exact_quantiles(df, [value], [0.5], [group]).select(group, F.col("p0").alias("_g"))
    overall = exact_quantiles(df, [value], [0.5]).select(F.col("p0").alias("_o"))
    joined = df.join(by_group, group, "left").crossJoin(F.broadcast(overall))
    return joined.withColumn(value, F.coalesce(value, "_g", "_o")).drop("_g", "_o")


def train_frequency(df: DataFrame, column: str, train, out: str) -> DataFrame:
    """Share of each value on the rows meeting ``train``, mapped to all rows, 0 for unseen values.

    Shares are broadcast if a count finds them few: few values would bring all rows to as few tasks.
    """
    counts = cut(df.filter(train).groupBy(column).agg(F.count("*").alias("_n")))
    few = counts.count() <= BROADCAST_ROWS
    total = counts.agg(F.sum("_n").alias("_t"))
    share = counts.crossJoin(F.broadcast(total)).select(column, (F.col("_n") / F.col("_t")).alias(out))
    return df.join(F.broadcast(share) if few else share, column, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def label_composition(df: DataFrame, label: str = "y_purchase", verified: str = "verified_purchase") -> DataFrame:
    """Verified, unverified and unknown shares of the positive rows (one row)."""
    text = F.lower(F.trim(F.col(verified).cast("string")))
    positive = F.col(label) == 1
    yes = positive & F.coalesce(text.isin("true", "1", "1.0"), F.lit(False))
    no = positive & F.coalesce(text.isin("false", "0", "0.0"), F.lit(False))
    return df.agg(
        F.count_if(positive).alias("positive_rows"),
        F.count_if(yes).alias("verified_true_rows"),
        F.count_if(no).alias("verified_false_rows"),
        F.count_if(positive & ~yes & ~no).alias("verified_missing_rows"),
        F.try_divide(F.count_if(yes), F.count_if(yes | no)).alias("verified_share_among_known"),
        F.count_if(F.col(label) == 0).alias("sampled_nonpurchase_rows"),
    )


def dataset_statistics(users: DataFrame, items: DataFrame, events: DataFrame, reviews: DataFrame, ratings: DataFrame):
    """One row of dataset sizes, density, stage totals, review length and mean rating."""
    lines = reviews.select(F.explode(F.split("review_text", "\n")).alias("_line")).filter(F.trim("_line") != "")
    words = F.size(F.split(F.trim(F.regexp_replace("_line", r"\s+", " ")), " "))
    parts = [
        users.agg(F.countDistinct("user_id").alias("users")),
        items.agg(F.countDistinct("item_id").alias("items")),
        events.agg(
            F.count("*").alias("interactions"), *[F.sum(f"y_{s}").cast("bigint").alias(f"{s}s") for s in STAGES]
        ),
        lines.agg(F.count("*").alias("reviews"), F.avg(words).alias("avg_review_length")),
        ratings.agg(F.count("*").alias("ratings"), F.avg(safe_double("rating")).alias("avg_rating")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(F.broadcast(part))
    density = F.col("interactions") / (F.col("users") * F.col("items")) * 100
    return row.withColumn("density_percent", density)


def popularity(edges: DataFrame, items: DataFrame, item: str = "item_id") -> DataFrame:
    """Edge count per known item, its log and the log's z-score over all known items."""
    counts = edges.groupBy(item).agg(F.count("*").alias("_n"))
    all_items = items.select(item).distinct().join(counts, item, "left")
    logged = all_items.select(
        item,
        F.coalesce("_n", F.lit(0)).alias("popularity"),
        F.log1p(F.coalesce("_n", F.lit(0)).cast("double")).alias("popularity_log"),
    )
    return z_scale(logged, ["popularity_log"], "_z")


def slot_popularity(events: DataFrame, items: DataFrame, order: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Laplace-smoothed share of every item in every equal-row time slot, min-max scaled within the slot.

    Items without events in a slot are listed with zero events, as is every item of a slot
    that got no rows at all.
    """
    known = items.select("item_id").distinct()
    numbered = global_row_number(events.join(known, "item_id", "left_semi"), order, "_rn")
    total = numbered.agg(F.count("*").alias("_total"))
    slot = F.least(F.lit(slots - 1), F.floor((F.col("_rn") - 1) * slots / F.col("_total")))
    slotted = numbered.crossJoin(F.broadcast(total)).withColumn("slot", slot.cast("int"))
    counts = slotted.groupBy("slot", "item_id").agg(F.count("*").alias("events"))
    every = known.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    filled = every.join(counts, ["slot", "item_id"], "left").withColumn("events", F.coalesce("events", F.lit(0)))
    # one row per slot
    sizes = filled.groupBy("slot").agg(
        F.sum("events").alias("_n"), F.count("*").alias("_items"), F.max("events").alias("_hi"), F.min("events").alias("_lo")
    )
    share = lambda c: (F.col(c) + 1.0) / (F.col("_n") + F.col("_items"))
    return filled.join(F.broadcast(sizes), "slot").select(
        "slot",
        "item_id",
        "events",
        share("events").alias("smoothed_share"),
        ((share("events") - share("_lo")) / (share("_hi") - share("_lo") + 1e-10)).alias("scaled_popularity"),
    )


def bipartite_edges(edges: DataFrame, n_users: int) -> DataFrame:
    """(u, i) index pairs as directed edges in both directions; item nodes follow user nodes."""
    node = (F.col("i") + n_users).alias
    forward = edges.select(F.col("u").alias("src"), node("dst"))
    return forward.unionByName(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def normalized_adjacency(graph: DataFrame, symmetric: bool = True) -> DataFrame:
    """Edge weights 1/sqrt(d_src d_dst), or 1/d_src for the row-normalised variant."""
    degree = graph.groupBy("src").agg(F.count("*").alias("_d"))
    weighted = graph.join(degree, "src")
    if not symmetric:
        return weighted.select("src", "dst", (1.0 / F.col("_d")).alias("weight"))
    other = degree.select(F.col("src").alias("dst"), F.col("_d").alias("_e"))
    both = weighted.join(other, "dst")
    return both.select("src", "dst", (1.0 / F.sqrt(F.col("_d").cast("double") * F.col("_e"))).alias("weight"))


def interaction_lines(edges: DataFrame, user: str, item: str) -> DataFrame:
    """Text lines ``user item item ...``, one per user, items in order."""
    lists = edges.select(user, item).distinct().groupBy(user).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return lists.select(F.concat_ws(" ", F.col(user).cast("string"), F.array_join(F.transform("_items", lambda x: x.cast("string")), " ")).alias("value"))


def pair_lines(edges: DataFrame, columns: Sequence[str], separator: str = " ") -> DataFrame:
    return edges.select(F.concat_ws(separator, *[F.col(c).cast("string") for c in columns]).alias("value"))

