"""Global order without a single-task window.

Rows are range-sorted once, so one hot key spans as many tasks as its rows
need. ``monotonically_increasing_id`` then encodes (partition, position). The
sorted rows are stored so every later use sees the same partitions. What
crosses partitions is one total per partition, or per (partition, key).
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelweir.session import cut, stored

_POSITION_BITS = 33


def _sorted_with_partition(df: DataFrame, order: Sequence, drop: Sequence[str] = ()) -> DataFrame:
    ranked = df.orderBy(*order).withColumn("__mid", F.monotonically_increasing_id())
    return stored(
        ranked.withColumn("__pid", F.shiftright("__mid", _POSITION_BITS).cast("int"))
        .withColumn("__pos", F.col("__mid").bitwiseAND((1 << _POSITION_BITS) - 1))
        .drop("__mid", *drop)
    )


def global_row_number(df: DataFrame, order: Sequence, out: str = "row_number", drop: Sequence[str] = ()) -> DataFrame:
    """1-based row number over the whole frame. ``order`` must be a total order; ``drop`` names columns that only order."""
    rows = _sorted_with_partition(df, order, drop)
    totals = rows.groupBy("__pid").agg(F.count("*").alias("__n"))
    # one row per partition, so this window and the broadcast are bounded
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (
        rows.join(F.broadcast(offsets), "__pid")
        .withColumn(out, F.col("__off") + F.col("__pos") + 1)
        .drop("__pid", "__pos", "__off")
    )


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str],
) -> DataFrame:
    """Exclusive running sums per key: ``sums`` maps output to input column.

    ``(keys, order)`` must be unique. A key may own any share of the rows.
    """
    rows = _sorted_with_partition(df, [*keys, *order]).drop("__pos")
    groups = ["__pid", *keys]
    local = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"__in_{o}") for o, c in sums.items()])
    totals = rows.groupBy(*groups).agg(*[F.sum(c).alias(f"__tot_{o}") for o, c in sums.items()])
    # a key has one row per partition it spans
    span = Window.partitionBy(*keys) if keys else Window.partitionBy()
    span = span.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, *[F.coalesce(F.sum(f"__tot_{o}").over(span), F.lit(0)).alias(f"__off_{o}") for o in sums]
    )
    conditions = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups]
    joined = inside.alias("l").join(offsets.alias("r"), conditions, "left")
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"l.__in_{o}") + F.col(f"r.__off_{o}")).alias(o) for o in sums],
    )


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value; map-side combined, so a hot value costs one row per task."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_cnt"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their average rank and group size: by, value, avg_rank, n."""
    counts = prefix_sums(value_counts(df, value, by), by, [value], {"_before": "_cnt"})
    totals = counts.groupBy(*by).agg(F.sum("_cnt").alias("n"))
    ranked = counts.withColumn("avg_rank", F.col("_before") + (F.col("_cnt") + 1) / 2.0)
    joined = ranked.join(totals, list(by)) if by else ranked.crossJoin(F.broadcast(totals))
    return joined.select(*by, value, "avg_rank", "n")


def melt(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), name="name", value="value") -> DataFrame:
    """Wide to long with the values as doubles."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*ids, F.inline(pairs))


SKETCH_ACCURACY = 10_000
#: Rows of limits (a few numbers each) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 10_000


def _null_safe(left: str, right: str, columns: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles, exact at any size and for any number of groups: by, name, p0, p1, ...

    One scan sketches every column of every group; a sketch misses a rank by n / accuracy
    at most, so two such steps to each side of a rank bracket it for certain. A second scan
    counts the values below each bracket, a third takes out the values inside, at most
    6 in 10,000 of a group's rows or 20,000. Only these are ordered, per group, column and
    rank. Nothing but limits and counts, one row per group, is stored, and nothing is collected; the limits
    are broadcast if a count finds them few.
    """
    ids = [*by, "name"]
    long = melt(df, columns, by).filter(F.col("value").isNotNull())
    slack, places = 2.0 / SKETCH_ACCURACY, range(len(probs))
    bounds = [b for p in probs for b in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = long.groupBy(*ids).agg(F.count("*").alias("_n"), F.percentile_approx("value", bounds, SKETCH_ACCURACY).alias("_b"))
    # in a group this small a bracket of slack may be narrower than a rank, so it is the whole group
    side = lambda k, whole: F.when(F.col("_n") < 2 * SKETCH_ACCURACY, F.lit(float(whole))).otherwise(F.col("_b")[k])
    edges = [e for j in places for e in (side(2 * j, "-inf").alias(f"_l{j}"), side(2 * j + 1, "inf").alias(f"_h{j}"))]
    limits = cut(sketch.select(*ids, "_n", *edges))
    few = limits.count() <= BROADCAST_ROWS
    wide = long.alias("l").join((F.broadcast(limits) if few else limits).alias("r"), _null_safe("l", "r", ids)).select("l.*", *[f"r.{side}{j}" for j in places for side in ("_l", "_h")])
    value, low, high = F.col("value"), (lambda j: F.col(f"_l{j}")), (lambda j: F.col(f"_h{j}"))
    # the edges themselves may be hot values, so they are counted, never taken out
    tests = {"_c": lambda j: value < low(j), "_e": lambda j: value == low(j), "_g": lambda j: (value == high(j)) & (low(j) < high(j))}
    below = cut(wide.groupBy(*ids).agg(*[F.count_if(test(j)).alias(f"{k}{j}") for j in places for k, test in tests.items()]))
    inside = [(value > low(j)) & (value < high(j)) for j in places]
    hits = [F.when(c, F.struct(F.lit(j).alias("_p"), value.alias("value"))) for j, c in enumerate(inside)]
    near = wide.filter(functools.reduce(operator.or_, inside)).select(*ids, F.inline(F.array_compact(F.array(*hits))))
    groups = [*ids, "_p"]
    beside = below.alias("l").join(limits.alias("r"), _null_safe("l", "r", ids))
    keys = [F.col(f"l.{k}").alias(k) for k in ids]
    ends = F.array(*[F.struct(F.lit(j).alias("_p"), F.col(f"r.{e}{j}").alias("value"), F.col(f"l.{k}{j}").alias("_cnt")) for j in places for e, k in (("_l", "_e"), ("_h", "_g"))])
    counts = near.groupBy(*groups, "value").agg(F.count("*").alias("_cnt")).unionByName(beside.select(*keys, F.inline(ends)).filter("_cnt > 0"))
    before = Window.partitionBy(*groups).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    # one row per group, column and rank: what lies below, and where the rank is
    wanted = F.array(*[F.struct(F.lit(j).alias("_p"), F.lit(float(p)).alias("_prob"), F.col("r._n").alias("_n"), F.col(f"l._c{j}").alias("_below")) for j, p in enumerate(probs)])
    offsets = beside.select(*keys, F.inline(wanted))
    placed = ranked.alias("l").join(offsets.alias("r"), _null_safe("l", "r", groups))
    target, first = (F.col("r._n") - 1) * F.col("r._prob"), F.col("l._before") + F.col("r._below")
    holds = lambda position: (first <= position) & (position < first + F.col("l._cnt"))
    found = placed.groupBy(*[F.col(f"l.{g}").alias(g) for g in groups]).agg(
        F.max(F.when(holds(F.floor(target)), F.col("l.value"))).alias("_lo"),
        F.max(F.when(holds(F.ceil(target)), F.col("l.value"))).alias("_hi"),
        F.max(target - F.floor(target)).alias("_t"),
    )
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_t")
    return found.groupBy(*ids).agg(*[F.max(F.when(F.col("_p") == j, at)).alias(f"p{j}") for j in places])


def quantile_scalars(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    """The quantiles of one column as driver numbers (``len(probs)`` values)."""
    row = exact_quantiles(df, [column], probs).first()
    return [None] * len(probs) if row is None else [row[f"p{i}"] for i in range(len(probs))]


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Distinct equal-frequency edges per column (at most ``bins + 1`` numbers each)."""
    rows = exact_quantiles(df, columns, [i / bins for i in range(bins + 1)]).collect()
    return {r["name"]: sorted({r[f"p{i}"] for i in range(bins + 1)}) for r in rows}


def right_closed_bin(column: Column, edges: Sequence[float]) -> Column:
    """0-based bin with intervals ``(edge, next]``; the lowest edge belongs to bin 0."""
    inner = edges[1:-1]
    total = F.lit(0)
    for edge in inner:
        total = total + (column > F.lit(float(edge))).cast("int")
    return F.when(column.isNotNull(), total)
