"""Samples by seeded hash order: reproducible, exact in size, independent of partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelweir.functions.hashing import hash_index, hash_key
from funnelweir.operators.ordering import global_row_number, prefix_sums, quantile_edges, right_closed_bin
from funnelweir.session import cut, stored

# draws of one user are generated in blocks of this many, so a long walk is shared by several tasks
WALK_BLOCK = 1024


def next_prime(n: int) -> int:
    """Smallest prime >= n."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def item_index(items: DataFrame, item: str) -> tuple[DataFrame, int]:
    """Distinct items with a dense index ``_idx`` and their number."""
    pool = global_row_number(items.select(item).distinct(), [item], "_idx").withColumn("_idx", F.col("_idx") - 1)
    size = pool.count()
    return pool, size


def unseen_places(
    users: DataFrame, user: str, pool: DataFrame, item: str, seen: DataFrame, k: int, seed
) -> tuple[DataFrame, DataFrame]:
    """The walks of :func:`uniform_unseen`: (user, first draw ``_draw`` and pool numbers ``_places`` of a block of steps), stored, and the numbered pool.

    A seen item is met at one step of the user's walk, which the inverse of the stride gives,
    so only steps that meet one are rows; a block's other steps are an array.
    """
    indexed, size = item_index(pool, item)
    prime = next_prime(size)

    @F.pandas_udf("long")
    def inverse(values: pd.Series) -> pd.Series:
        return pd.Series([pow(int(v), -1, prime) for v in values], dtype="int64")

    stride = hash_index(max(1, prime - 1), f"{seed}|stride", user) + 1
    start = hash_index(prime, f"{seed}|start", user)
    names = users.select(user).distinct()
    blocked = seen.select(user, item).distinct().join(names, user, "left_semi").join(indexed, item).select(user, "_idx")
    blocked = blocked.withColumns({"_inverse": inverse(stride), "_start": start})
    met = stored(blocked.select(user, (((F.col("_idx") - F.col("_start") + prime) % prime) * F.col("_inverse") % prime).alias("_j")))
    counts = met.groupBy(user).agg(F.count("*").alias("_blocked"))
    steps = F.least(F.lit(prime), F.lit(k + prime - size) + F.coalesce("_blocked", F.lit(0)))
    walkers = names.join(counts, user, "left").select(user, steps.alias("_steps"))
    block = F.floor(F.col("_j") / WALK_BLOCK)
    near = met.join(walkers, user).filter(F.col("_j") < F.col("_steps"))
    lists = near.groupBy(user, block.alias("_block")).agg(F.collect_list("_j").alias("_met"))
    blocks = walkers.select(user, "_steps", F.explode(F.sequence(F.lit(0), F.floor((F.col("_steps") - 1) / WALK_BLOCK))).alias("_block"))
    last = F.least(F.col("_steps"), (F.col("_block") + 1) * WALK_BLOCK) - 1
    free = F.array_except(F.sequence(F.col("_block") * WALK_BLOCK, last), F.coalesce("_met", F.array().cast("array<bigint>")))
    # few bytes become many steps, so the number of tasks is stated: small partitions would be merged into one task that makes
    # all steps. By user, as the sums below ask for, so the steps made are not shuffled. The number is one of its own, as
    # the usual one would be taken for the partitions of a join above, which are merged
    parts = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    joined = blocks.join(lists, [user, "_block"], "left").repartition(parts, user).withColumns({"_stride": stride, "_start": start})
    place = F.transform(free, lambda j: (F.col("_stride") * j + F.col("_start")) % prime)
    held = joined.select(user, "_block", F.filter(place, lambda v: v < size).alias("_places"))
    # one row per block of a user's walk
    mine = Window.partitionBy(user)
    before = F.coalesce(F.sum(F.size("_places")).over(mine.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = held.withColumns({"_before": before, "_all": F.sum(F.size("_places")).over(mine)}).filter((F.col("_all") >= k) & (F.col("_before") < k))
    left = (F.lit(k) - F.col("_before")).cast("int")
    return stored(placed.select(user, (F.col("_before") + 1).alias("_draw"), F.slice("_places", 1, left).alias("_places"))), indexed


def named_places(places: DataFrame, user: str, indexed: DataFrame, item: str) -> DataFrame:
    each = places.select(user, "_draw", F.posexplode("_places").alias("_at", "_idx"))
    return each.join(indexed, "_idx").select(user, item, (F.col("_draw") + F.col("_at")).cast("int").alias("draw"))


def uniform_unseen(
    users: DataFrame, user: str, pool: DataFrame, item: str, seen: DataFrame, k: int, seed
) -> DataFrame:
    """``k`` items per user, without replacement, uniform over the pool minus the user's seen items.

    Each user walks the pool by a seeded affine step modulo a prime, which
    visits every index once. ``k + seen + (prime - pool)`` steps always hold
    ``k`` unseen items if the user has that many, so nothing is retried and no
    user-by-item product is formed. Users with fewer than ``k`` are dropped.
    Returns user, item, ``draw`` (1..k).
    """
    places, indexed = unseen_places(users, user, pool, item, seen, k, seed)
    return named_places(places, user, indexed, item)


def rejection_draws(
    rows: DataFrame,
    keys: Sequence[str],
    user: str,
    pool: DataFrame,
    item: str,
    seen: DataFrame,
    k: int,
    seed,
    first: int,
    limit: int,
    out: str = "sampled_item",
    unique: bool = False,
) -> DataFrame:
    """``k`` unseen items per row, drawn with replacement in at most ``limit`` attempts.

    A round of ``k`` attempts serves almost every row; only rows left short go on to ``first``
    attempts, and what is still short to ``limit``. Draws stay pool numbers with a mark of what
    the user has seen, stored once a round; items get their names at the end. ``unique`` says
    that ``keys`` name a row, so single draws need no count. Returns keys, out, ``attempt``.
    """
    indexed, size = item_index(pool, item)
    blocked = seen.select(user, item).distinct().join(indexed, item).select(user, "_idx", F.lit(True).alias("_seen"))
    ids = list(dict.fromkeys([*keys, user]))
    part, kept = rows.select(*ids, F.lit(0).alias("_have")), None
    inside = Window.partitionBy(*keys)
    upto = inside.orderBy("attempt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for low, high in ((1, min(k, first)), (min(k, first) + 1, first), (first + 1, limit)):
        if low > high:
            continue
        attempts = part.withColumn("attempt", F.explode(F.sequence(F.lit(low), F.lit(high))))
        marked = attempts.withColumn("_idx", hash_index(size, seed, *keys, "attempt")).join(blocked, [user, "_idx"], "left")
        fresh = F.col("_seen").isNull() & F.col("_idx").isNotNull()
        one = fresh.cast("int")
        alone = unique and low == high
        number, total = (one, one) if alone else (F.sum(one).over(upto), F.sum(one).over(inside))
        counts = {"_number": F.col("_have") + number, "_total": F.col("_have") + total}
        round_ = stored(marked.withColumns({"_fresh": fresh, **counts}).drop("_have", "_seen"))
        taken = round_.filter(F.col("_fresh") & (F.col("_number") <= k)).select(*ids, "_idx", "attempt")
        kept = taken if kept is None else kept.unionByName(taken)
        part = round_.filter((F.col("attempt") == low) & (F.col("_total") < k)).select(*ids, F.col("_total").alias("_have"))
        if part.isEmpty():
            break
    return kept.join(indexed.withColumnRenamed(item, out), "_idx").select(*ids, out, "attempt")


def training_triples(edges: DataFrame, user: str, item: str, pool: DataFrame, samples: int, seed, attempts: int = 100) -> DataFrame:
    """(sample, user, item, negative) with one unseen negative per edge and sample.

    Edges whose ``attempts`` draws all hit seen items walk the pool instead, which finds an
    unseen item wherever the user has one; users who have seen every item give no rows.
    """
    pairs = stored(edges.select(user, item).distinct())
    rows = pairs.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    drawn = rejection_draws(rows, ["sample", user, item], user, pool, item, pairs, 1, seed, min(4, attempts), attempts, "negative", True)
    drawn = stored(drawn.select("sample", user, item, "negative"))
    if drawn.count() == pairs.count() * samples:
        return drawn
    left = rows.join(drawn, ["sample", user, item], "left_anti")
    left = cut(left.withColumn("_edge", F.to_json(F.struct("sample", user, item))))
    if left.isEmpty():
        return drawn
    seen = left.select("_edge", user).join(pairs, user).select("_edge", item)
    walked = uniform_unseen(left, "_edge", pool, item, seen, 1, seed).select("_edge", F.col(item).alias("negative"))
    return drawn.unionByName(left.join(walked, "_edge").select("sample", user, item, "negative"))


def hash_top(df: DataFrame, by: Sequence[str], n: int, seed, key: Sequence[str]) -> DataFrame:
    """``n`` rows per group in hash order; each task keeps at most ``n`` per group before the shuffle."""
    order = Window.partitionBy(*by).orderBy(hash_key(seed, *key), *key)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def nested_subsample(candidates: DataFrame, group: Sequence[str], item: str, count: int, seed, replicate: int):
    """``count`` of each group's negatives by hash order of the replicate; targets are always kept."""
    negatives = hash_top(candidates.filter(~F.col("is_target")), group, count, f"{seed}|{replicate}", [*group, item])
    return negatives.unionByName(candidates.filter("is_target"))


def absence_band(columns: Sequence[str]):
    zeros = F.lit(0)
    for c in columns:
        zeros = zeros + F.coalesce((F.col(c) == 0).cast("int"), F.lit(0))
    return F.when(zeros <= 0, "none").when(zeros <= 3, "some").otherwise("many")


def stratified_sample(df: DataFrame, key: str, columns: Sequence[str], n: int, seed) -> DataFrame:
    """``n`` rows balanced over absence band x intensity quartile, topped up by hash order."""
    total, known = F.lit(0.0), F.lit(0)
    for c in columns:
        clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
        total = total + F.coalesce(clipped, F.lit(0.0))
        known = known + F.col(c).isNotNull().cast("int")
    work = df.withColumns({"_mean": F.try_divide(total, known), "_band": absence_band(columns)})
    edges = quantile_edges(work, ["_mean"], 4).get("_mean", [])
    quartile = F.coalesce(right_closed_bin(F.col("_mean"), edges).cast("string"), F.lit("nan"))
    work = work.withColumns({"_stratum": F.concat_ws("_", "_band", quartile), "_h": hash_key(seed, key)})
    strata = work.select("_stratum").distinct().count()
    target = max(1, math.ceil(n / max(1, strata)))
    order = Window.partitionBy("_stratum").orderBy("_h", key)
    chosen = work.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= target).drop("_r")
    rest = work.join(chosen.select(key), key, "left_anti").withColumn("_phase", F.lit(1))
    both = chosen.withColumn("_phase", F.lit(0)).unionByName(rest)
    by_stratum = F.when(F.col("_phase") == 0, F.col("_stratum")).otherwise("")
    return both.orderBy("_phase", by_stratum, "_h", key).limit(n).drop("_mean", "_band", "_stratum", "_h", "_phase")


def proportional_cap(df: DataFrame, label: str, key: Sequence[str], maximum: int, seed) -> DataFrame:
    """At most ``maximum`` rows with every class at its share; the whole frame if it is smaller."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if maximum <= 0 or total <= maximum:
        return df
    target = F.lit(0)
    for value, n in sizes.items():
        wanted = max(1, round(maximum * n / total))
        target = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(wanted)).otherwise(target)
    keyed = df.withColumns({"_h": hash_key(seed, *key), "_one": F.lit(1)})
    ranked = prefix_sums(keyed, [label], ["_h", *key], {"_before": "_one"})
    taken = ranked.filter(F.col("_before") < target)
    return taken.orderBy("_h", *key).limit(maximum).drop("_h", "_one", "_before")

