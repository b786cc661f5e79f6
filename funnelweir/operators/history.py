"""Features from events strictly before each row's own timestamp."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelweir.functions.scalars import clip
from funnelweir.operators.ordering import prefix_sums


def running_before(
    totals: DataFrame, keys: Sequence[str], ts: str, sums: Mapping[str, str], few_times: bool = True
) -> DataFrame:
    """Sums over strictly earlier times. ``totals`` holds one row per (keys, ts).

    ``few_times``: day keys, so a key owns at most one row per day and a plain
    window is bounded whatever the key's share of events. For fine-grained
    clocks pass ``False``: a range-sorted prefix sum then spreads a hot key.
    """
    if not few_times:
        return prefix_sums(totals, keys, [ts], sums)
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({o: F.coalesce(F.sum(c).over(w), F.lit(0)) for o, c in sums.items()})


def prior_counts(
    df: DataFrame, user: str, ts: str, flags: Mapping[str, str], few_times: bool = True
) -> DataFrame:
    """Add ``events_pre`` and one strictly-prior sum per flag, with log1p twins.

    ``flags`` maps a short name (``clicks``) to a 0/1 column. Also adds
    ``history_max_ts``, the latest earlier timestamp of the user.
    """
    totals = df.groupBy(user, ts).agg(
        F.count("*").alias("_events"), *[F.sum(c).alias(f"_{name}") for name, c in flags.items()]
    )
    names = ["events", *flags]
    before = running_before(totals, [user], ts, {f"{n}_pre": f"_{n}" for n in names}, few_times)
    if few_times:
        latest = F.lag(ts).over(Window.partitionBy(user).orderBy(ts))
        before = before.withColumn("history_max_ts", latest)
    kept = before.drop(*[f"_{n}" for n in names])
    out = df.join(kept, [user, ts], "left")
    return out.withColumns({f"user_{n}_pre_log": F.log1p(F.col(f"{n}_pre").cast("double")) for n in names})


def category_affinity(
    df: DataFrame,
    user: str,
    category: str,
    ts: str,
    flag: str,
    missing: float | None = 0.01,
    out: str = "T_int_sem",
    few_times: bool = True,
) -> DataFrame:
    """Share of the user's earlier positive events that fall in this row's category.

    ``missing`` fills rows without earlier events; ``None`` leaves NULL and adds
    ``<out>_available``. Always adds ``<out>_numerator`` and ``<out>_denominator``.
    """
    by_category = df.groupBy(user, category, ts).agg(F.sum(flag).alias("_n"))
    by_user = by_category.groupBy(user, ts).agg(F.sum("_n").alias("_n"))
    numerator, denominator = f"{out}_numerator", f"{out}_denominator"
    cat_before = running_before(by_category, [user, category], ts, {numerator: "_n"}, few_times).drop("_n")
    user_before = running_before(by_user, [user], ts, {denominator: "_n"}, few_times).drop("_n")
    # both sides hold at most one row per (user, category, day); the fact table is joined once
    shares = cat_before.join(user_before, [user, ts])
    share = clip(F.try_divide(F.col(numerator), F.col(denominator)))
    shares = shares.withColumn(out, share if missing is None else F.coalesce(share, F.lit(float(missing))))
    if missing is None:
        shares = shares.withColumn(f"{out}_available", (F.col(denominator) > 0).cast("int"))
    return df.join(shares, [user, category, ts], "left")


def asof_points(
    events: DataFrame,
    history: DataFrame,
    by: str,
    ts: str,
    sums: Mapping[str, str],
    count: str | None = "n_pre",
    few_times: bool = True,
) -> DataFrame:
    """Totals of ``history`` rows with an earlier ``ts``, one row per (by, ts) of ``events``.

    Both sides meet before they shrink, so one aggregation serves both.
    """
    outputs = [*sums, *([count] if count else [])]
    past = history.filter(F.col(by).isNotNull() & F.col(ts).isNotNull())
    past = past.select(by, ts, F.lit(0).alias("_probe"), *[F.col(c).alias(f"_{o}") for o, c in sums.items()])
    merged = past.unionByName(events.select(by, ts, F.lit(1).alias("_probe")), allowMissingColumns=True)
    measures = [F.sum(f"_{o}").cast("double").alias(f"_{o}") for o in sums]
    if count:
        measures.append(F.sum(F.when(F.col("_probe") == 0, F.lit(1))).alias(f"_{count}"))
    points = merged.groupBy(by, ts).agg(*measures, F.max("_probe").alias("_probe"))
    before = running_before(points, [by], ts, {o: f"_{o}" for o in outputs}, few_times)
    return before.filter("_probe = 1").select(by, ts, *outputs)


def asof_prior(
    events: DataFrame,
    history: DataFrame,
    by: str,
    ts: str,
    sums: Mapping[str, str],
    count: str | None = "n_pre",
    few_times: bool = True,
) -> DataFrame:
    """Strict backward as-of: totals of ``history`` rows with an earlier ``ts``.

    ``sums`` maps output to history column; ``count`` names the row count.
    Both sides shrink to one row per (by, ts) before they meet the events.
    """
    return events.join(asof_points(events, history, by, ts, sums, count, few_times), [by, ts], "left")


def rating_points(events: DataFrame, ratings: DataFrame, few_times: bool = True) -> DataFrame:
    """Count and mean of an item's earlier ratings per (item, time) of the events; the mean divides by all earlier rows."""
    known = ratings.withColumn("_known", F.col("rating").isNotNull().cast("int"))
    sums = {"_rating_sum": "rating", "_rating_known": "_known"}
    points = asof_points(events, known, "item_id", "timestamp", sums, "item_review_count_pre", few_times)
    mean = F.try_divide(F.col("_rating_sum"), F.col("item_review_count_pre"))
    # no usable rating yet is missing, not zero
    return points.withColumn("item_rating_mean_pre", F.when(F.col("_rating_known") > 0, mean)).drop(*sums)


def rating_history(events: DataFrame, ratings: DataFrame, few_times: bool = True) -> DataFrame:
    """Events with count and mean of their item's earlier ratings."""
    return events.join(rating_points(events, ratings, few_times), ["item_id", "timestamp"], "left")


def user_days(
    df: DataFrame,
    user: str,
    category: str,
    ts: str,
    flags: Mapping[str, str],
    affinity: str,
    missing: float = 0.01,
    out: str = "T_int_sem",
) -> DataFrame:
    """``prior_counts`` and ``category_affinity`` of one key table: a row per (user, category, ts).

    ``ts`` holds whole numbers such as day keys. The rows are shuffled by user once for all figures; ``affinity``
    names the flag whose earlier sums make the share. ``_rows`` counts the rows of ``df``; the counts ``<flag>_pre``
    stay counts, for the caller to take logs of after its join. Figures are missing where ``ts`` is.
    """
    totals = df.groupBy(user, category, ts).agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_{n}") for n, c in flags.items()])
    earlier = Window.partitionBy(user).orderBy(ts).rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(user, category).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    given = F.col(ts).isNotNull()
    count = lambda c, w: F.when(given, F.coalesce(F.sum(F.when(given, F.col(c))).over(w), F.lit(0)))
    figures = {f"{n}_pre": count(c, earlier) for n, c in {"events": "_rows", **{n: f"_{n}" for n in flags}}.items()}
    figures["history_max_ts"] = F.when(given, F.max(ts).over(earlier))
    before = totals.withColumns(figures).withColumn("_own", count(f"_{affinity}", own))
    share = F.coalesce(clip(F.try_divide(F.col("_own"), F.col(f"{affinity}_pre"))), F.lit(float(missing)))
    return before.withColumn(out, F.when(given, share)).drop("_own", *[f"_{n}" for n in flags])


def history_audit(df: DataFrame, required: str, source_ts: str, ts: str) -> DataFrame:
    """Rows whose needed history is not strictly earlier than the event."""
    ok = (F.coalesce(F.col(required), F.lit(0)) <= 0) | (F.col(source_ts) < F.col(ts))
    return df.agg(
        F.count("*").alias("audited_rows"),
        F.max(source_ts).alias("max_source_timestamp"),
        F.min(ts).alias("min_event_timestamp"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("violations"),
    ).withColumn("pass", F.col("violations") == 0)
