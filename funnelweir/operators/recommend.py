"""Causal priors, candidate scoring and policy tables for re-ranking."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelweir.functions.scalars import safe_double
from funnelweir.operators import effects as E
from funnelweir.operators.funnel import flag
from funnelweir.operators.moments import ALL
from funnelweir.operators.ordering import exact_quantiles
from funnelweir.operators.projection import apply_projection, fit_projection
from funnelweir.operators.ranking import is_tied, tie_metrics
from funnelweir.operators.ranks import history_level
from funnelweir.operators.splits import two_way_boundary
from funnelweir.session import cut, stored

# fixed values: weight of each stage in the dynamic policy score
STAGE_WEIGHTS = {"click": 0.1, "cart": 0.2, "purchase": 0.7}
PRIOR_MIN_ROWS = 500


def end_of_window_levels(history: DataFrame, cuts: Sequence[float], user: str = "user_id") -> DataFrame:
    """User level after all events up to the cutoff: user, level."""
    counts = history.groupBy(user).agg(F.log1p(F.count("*").cast("double")).alias("_x"))
    return counts.select(user, history_level("_x", cuts).alias("level"))


def last_row_levels(history: DataFrame, ts: str, level: str, user: str = "user_id") -> DataFrame:
    """The superseded state: the level on each user's last row."""
    last = history.groupBy(user).agg(F.max_by(level, F.struct(ts, "item_id")).alias("_l"))
    clipped = F.least(F.lit(3), F.greatest(F.lit(0), F.coalesce(safe_double("_l"), F.lit(0.0)).cast("int")))
    return last.select(user, clipped.alias("legacy_level"))


def state_audit(candidates: DataFrame, current: DataFrame, legacy: DataFrame, user: str = "user_id") -> DataFrame:
    """Level counts and mismatches between the two states over candidate users, per stage."""
    users = candidates.select("stage", user).distinct()
    both = users.join(current, user, "left").join(legacy, user, "left").fillna(0, ["level", "legacy_level"])
    differs = F.col("level") != F.col("legacy_level")
    return both.groupBy("stage").agg(
        F.count("*").alias("candidate_users"),
        F.count_if(F.col("legacy_level") == 0).alias("legacy_h0_users"),
        F.count_if(differs).alias("state_mismatch_users"),
        F.avg(differs.cast("double")).alias("state_mismatch_rate"),
        *[F.count_if(F.col("level") == k).alias(f"corrected_h{k}_users") for k in range(4)],
    )


def semantic_history(df: DataFrame, categories: DataFrame, user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Click totals per user and per (user, category)."""
    clicks = df.filter(flag("y_click") == 1).join(categories, "item_id", "left")
    named = clicks.withColumn("category", F.coalesce("category", F.lit("Unknown")))
    by_category = named.groupBy(user, "category").agg(F.count("*").alias("category_clicks"))
    return by_category.groupBy(user).agg(F.sum("category_clicks").alias("total_clicks")), by_category


def add_alignment(candidates: DataFrame, categories: DataFrame, totals: DataFrame, by_category: DataFrame, user="user_id"):
    """Share of the user's clicks in the candidate's category, 0 without clicks: column T_int_sem."""
    named = candidates.join(categories.select("item_id", "category"), "item_id", "left").withColumn(
        "category", F.coalesce("category", F.lit("Unknown"))
    )
    joined = named.join(totals, user, "left").join(by_category, [user, "category"], "left")
    share = F.coalesce(F.try_divide(F.coalesce("category_clicks", F.lit(0)), F.col("total_clicks")), F.lit(0.0))
    aligned = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
    return joined.withColumn("T_int_sem", aligned).drop("total_clicks", "category_clicks", "category")


def category_coverage(items: DataFrame, categories: DataFrame) -> DataFrame:
    """How many required items have a category (one row)."""
    joined = items.select("item_id").distinct().join(categories, "item_id", "left")
    return joined.agg(
        F.count("*").alias("required_items"),
        F.count("category").alias("mapped_items"),
        F.count_if(F.col("category").isNull()).alias("missing_items"),
        F.count_if(F.col("category") == "Unknown").alias("unknown_category_items"),
        F.try_divide(F.count("category"), F.count("*")).alias("mapping_rate"),
    )


def item_profiles(
    df: DataFrame, items: DataFrame, columns: Sequence[str], order: Sequence[str] = ("timestamp", "user_id")
) -> DataFrame:
    """Latest row per item, median fill, z-scale over observed items, 0 for unseen ones.

    Returns item_id, raw columns and ``<column>_z``.
    """
    clean = df.withColumns({c: safe_double(c) for c in columns})
    medians = {r["name"]: r["p0"] for r in exact_quantiles(clean, columns, [0.5]).collect()}
    latest = clean.groupBy("item_id").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    filled = latest.select(
        "item_id", *[F.coalesce(F.col(f"_r.{c}"), F.lit(float(medians.get(c) or 0.0))).alias(c) for c in columns]
    )
    scale = filled.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    joined = items.select("item_id").distinct().join(filled, "item_id", "left").crossJoin(F.broadcast(scale))
    out = []
    for c in columns:
        sd = F.when(F.col(f"_s_{c}") > 1e-8, F.col(f"_s_{c}")).otherwise(1.0)
        out.append(F.coalesce(F.col(c), F.lit(0.0)).alias(c))
        out.append(F.coalesce((F.col(c) - F.col(f"_m_{c}")) / sd, F.lit(0.0)).alias(f"{c}_z"))
    return joined.select("item_id", *out)


def scaled_features(df: DataFrame, items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature columns per item, 0 for missing, z-scaled over all items."""
    first = df.select("item_id", *columns).groupBy("item_id").agg(F.min(F.struct(*columns)).alias("_r"))
    filled = items.select("item_id").distinct().join(first, "item_id", "left").select(
        "item_id", *[safe_double(F.col(f"_r.{c}"), 0.0).alias(c) for c in columns]
    )
    scale = filled.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    wide = filled.crossJoin(F.broadcast(scale))
    sd = {c: F.when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return wide.select("item_id", *[((F.col(c) - F.col(f"_m_{c}")) / sd[c]).alias(c) for c in columns])


def causal_prior(
    residuals: DataFrame,
    outcomes: Sequence[str],
    heuristic: Sequence[str],
    analytical: Sequence[str],
    by: str | None = "H_level",
    limits: Mapping | None = None,
) -> DataFrame:
    """Coefficients on the original treatments per (stage, level); levels without full support use the total.

    Analytical treatments are purified by the heuristic ones on the same rows,
    the joint fit runs on that basis, and coefficients are mapped back. The columns
    are stored first, as several passes read them.
    """
    columns = dict.fromkeys([*([by] if by else []), *outcomes, *heuristic, *analytical])
    return _stored_prior(stored(residuals.select(*columns)), outcomes, heuristic, analytical, by, limits)


def _stored_prior(residuals: DataFrame, outcomes: Sequence[str], heuristic: Sequence[str], analytical: Sequence[str], by: str | None, limits: Mapping | None) -> DataFrame:
    filled = residuals.withColumns({c: safe_double(c, 0.0) for c in [*heuristic, *analytical, *outcomes]})
    fitted = fit_projection(filled, heuristic, analytical)
    pure_frame, pure = apply_projection(filled, heuristic, fitted)
    slopes = np.array(
        [[(fitted[t]["parameters"] or {}).get(f"_d_{c}", 0.0) for t in analytical] for c in heuristic]
    )
    columns = [*heuristic, *pure]
    gates = E.support_table(pure_frame, columns, by, **(limits or {}))
    fits = E.family_fits(pure_frame, outcomes, columns, gates, by, errors="none")
    rows = []
    for y in outcomes:
        total = None
        for level in [ALL, *sorted({lv for lv, _ in gates if lv != ALL})]:
            supported = [gates[(level, c)]["estimable"] for c in columns]
            n = max(gates[(level, c)]["support_n"] for c in columns)
            if n < PRIOR_MIN_ROWS:
                continue
            fallback = level != ALL and not all(supported)
            fit = fits.get((level, y))
            basis = np.array([fit.coefficient(c) if fit and c in fit.names else 0.0 for c in columns])
            k = len(heuristic)
            original = np.concatenate([basis[:k] - slopes @ basis[k:], basis[k:]])
            values = total if fallback and total is not None else original
            if level == ALL:
                total = original
            for c, value, ok in zip([*heuristic, *analytical], values, supported):
                rows.append((E._stage(y), level, E.component(c), c, float(value), int(n), bool(ok), fallback))
    schema = (
        "stage string, h_level string, component string, treatment string, coefficient double, n long, "
        "estimable boolean, fallback_to_total boolean"
    )
    return E.small_frame(residuals.sparkSession, rows, schema)


def prior_stability(
    residuals: DataFrame,
    ts: str,
    outcomes: Sequence[str],
    heuristic: Sequence[str],
    analytical: Sequence[str],
    min_sign_agreement: float,
    min_correlation: float,
    limits: Mapping | None = None,
) -> DataFrame:
    """Agreement of the total coefficients between the earlier and the later half, per stage."""
    residuals = stored(residuals.select(*dict.fromkeys([ts, *outcomes, *heuristic, *analytical])))
    boundary = F.lit(two_way_boundary(residuals, ts, 0.5))
    halves = [residuals.filter(F.col(ts) <= boundary), residuals.filter(F.col(ts) > boundary)]
    early, late = (
        _stored_prior(h, outcomes, heuristic, analytical, None, limits).select(
            "stage", "component", F.col("coefficient").alias(name), F.col("estimable").alias(f"{name}_ok")
        )
        for h, name in zip(halves, ("early", "late"))
    )
    both = early.join(late, ["stage", "component"])
    table = both.groupBy("stage").agg(
        F.avg((F.signum("early") == F.signum("late")).cast("double")).alias("sign_agreement"),
        F.corr("early", "late").alias("coefficient_correlation"),
        F.bool_and("early_ok").alias("early_supported"),
        F.bool_and("late_ok").alias("late_supported"),
    )
    passed = (
        F.col("early_supported")
        & F.col("late_supported")
        & (F.col("sign_agreement") + 1e-12 >= min_sign_agreement)
        & F.coalesce(F.col("coefficient_correlation") + 1e-12 >= min_correlation, F.lit(False))
    )
    return table.withColumn("gate_passed", passed)


def lift(coefficients: Mapping[str, float]) -> Column:
    """Weighted sum of treatment columns, missing treatments as 0."""
    total = F.lit(0.0)
    for column, value in coefficients.items():
        total = total + F.coalesce(safe_double(column), F.lit(0.0)) * F.lit(float(value))
    return total


def candidate_scores(candidates: DataFrame, profiles: DataFrame, levels: DataFrame, prior: DataFrame, treatments):
    """Causal score of every candidate: coefficients of the user's level (else the total) times the item's treatments.

    ``prior`` is a result table of a few rows per stage, so it is broadcast.
    """
    wide = prior.groupBy("stage", "h_level").pivot("component", [E.component(t) for t in treatments]).agg(
        F.first("coefficient")
    )
    named = wide.select("stage", "h_level", *[F.col(E.component(t)).alias(f"_c_{t}") for t in treatments])
    own = named.filter(F.col("h_level") != ALL).withColumnRenamed("h_level", "_level")
    total = named.filter(F.col("h_level") == ALL).drop("h_level")
    total = total.withColumnsRenamed({f"_c_{t}": f"_t_{t}" for t in treatments})
    joined = candidates.join(profiles, "item_id", "left").join(levels, "user_id", "left")
    joined = joined.withColumn("_level", F.coalesce("level", F.lit(0)).cast("string"))
    joined = joined.join(F.broadcast(own), ["stage", "_level"], "left").join(F.broadcast(total), "stage", "left")
    score = F.lit(0.0)
    for t in treatments:
        weight = F.coalesce(F.col(f"_c_{t}"), F.col(f"_t_{t}"), F.lit(0.0))
        score = score + weight * F.coalesce(F.col(t), F.lit(0.0))
    dropped = [c for t in treatments for c in (f"_c_{t}", f"_t_{t}")]
    return joined.withColumn("causal", score).drop(*dropped, "_level")


def calibration(scores: DataFrame, by: Sequence[str] = ("stage",), columns=("relevance", "causal")) -> DataFrame:
    """Mean and population deviation per stage (deviation 1 when degenerate)."""
    aggregates = [F.count("*").alias("pairs")]
    for c in columns:
        sd = F.stddev_pop(c)
        aggregates += [F.avg(c).alias(f"{c}_mean"), F.when(sd > 1e-12, sd).otherwise(1.0).alias(f"{c}_sd")]
    return scores.groupBy(*by).agg(*aggregates)


def blend(scores: DataFrame, calibrations: DataFrame, weight: Column, by: Sequence[str] = ("stage",)) -> DataFrame:
    """``z(relevance) + weight * z(causal)`` as column ``score``; calibrations hold one row per stage."""
    joined = scores.join(F.broadcast(calibrations), list(by))
    z = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in ("relevance", "causal")}
    return joined.withColumn("score", z["relevance"] + weight * z["causal"]).select(*scores.columns, "score")


def select_weight(
    scores: DataFrame, calibrations: DataFrame, weights: Sequence[float], gates: DataFrame, retention: float
) -> DataFrame:
    """Evaluate blend weights and mark the choice per stage.

    The choice has the highest discounted causal score among weights that keep
    mean NDCG, pass the paired one-sided noninferiority bound, and (unless 0)
    have a stable prior. ``gates`` is (stage, gate_passed).
    """
    # rows are shuffled once, by user list; a list is measured under all weights as it lies then
    keys = ["weight", "stage", "user_id"]
    names = [f"{c}_{side}" for c in ("relevance", "causal") for side in ("mean", "sd")]
    known = scores.join(F.broadcast(calibrations.select("stage", *names)), "stage").dropna(subset=["stage", "user_id"])
    z = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in ("relevance", "causal")}
    row = F.struct("item_id", "is_target", "causal", z["relevance"].alias("r"), z["causal"].alias("c"))
    lists = known.repartition("stage", "user_id").groupBy("stage", "user_id").agg(F.collect_list(row).alias("_rows"))
    runs = lists.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    # highest scores first, then items that are no target, then by name
    place = lambda s: F.when(F.isnan(s), float("-inf")).otherwise(-s)
    line = lambda x: F.struct(
        (x["r"] + F.col("weight") * x["c"]).isNull().alias("n"), place(x["r"] + F.col("weight") * x["c"]).alias("p"), x["is_target"].alias("is_target"), x["item_id"].alias("item_id"), x["causal"].alias("causal"), (x["r"] + F.col("weight") * x["c"]).alias("score")
    )
    runs = runs.select(*keys, F.transform("_rows", line).alias("_rows"))
    target = F.array_max(F.transform(F.filter("_rows", lambda x: x["is_target"]), lambda x: x["score"]))
    runs = runs.withColumn("_t", target)
    tied = F.filter("_rows", lambda x: is_tied(x["score"], F.col("_t")))
    better = F.filter("_rows", lambda x: (x["score"] > F.col("_t")) & ~is_tied(x["score"], F.col("_t")))
    top = F.slice(F.array_sort("_rows"), 1, 10)
    discounts = F.array(*[F.lit(1.0 / math.log2(k + 1)) for k in range(1, 11)])
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    gains = F.transform("_top", lambda x, i: x["causal"] * F.get(discounts, i))
    utility = F.when(F.exists("_top", lambda x: x["causal"].isNotNull()), total(gains) / total(F.slice(discounts, F.lit(1), F.size("_top"))))
    counted = runs.select(*keys, F.size(better).cast("long").alias("better"), F.size(tied).cast("long").alias("target_tie_size"), top.alias("_top"))
    measured = tie_metrics(counted.select(*keys, "better", "target_tie_size", utility.alias("utility")), (10,))
    base = F.max(F.when(F.col("weight") == 0.0, F.col("ndcg_10"))).over(Window.partitionBy("stage", "user_id"))
    paired = measured.withColumn("_base", base).filter("_base IS NOT NULL")
    change = F.col("ndcg_10") - F.col("_base")
    table = paired.groupBy("stage", "weight").agg(
        F.count("*").alias("validation_users"),
        F.avg("ndcg_10").alias("ndcg_10"),
        F.avg("_base").alias("baseline_ndcg_10"),
        F.avg("utility").alias("mean_causal_score"),
        F.avg(change).alias("ndcg_difference"),
        F.coalesce(F.stddev(change) / F.sqrt(F.count("*")), F.lit(0.0)).alias("ndcg_difference_se"),
    )
    lower = F.col("ndcg_difference") - 1.645 * F.col("ndcg_difference_se")
    allowed = (1.0 - retention) * F.col("baseline_ndcg_10")
    keeps = F.col("ndcg_10") + 1e-12 >= retention * F.col("baseline_ndcg_10")
    table = table.join(F.broadcast(gates.select("stage", "gate_passed")), "stage", "left").withColumns(
        {
            "one_sided_lower": lower,
            "allowed_degradation": allowed,
            "meets_retention": keeps,
            "noninferior": lower + 1e-12 >= -allowed,
        }
    )
    stable = F.coalesce(F.col("gate_passed"), F.lit(False)) | (F.col("weight") == 0.0)
    table = table.withColumn("eligible", F.col("meets_retention") & F.col("noninferior") & stable)
    best = Window.partitionBy("stage").orderBy(
        F.col("eligible").desc(), F.col("mean_causal_score").desc(), F.col("ndcg_10").desc(), F.col("weight").asc()
    )
    chosen = (F.row_number().over(best) == 1) & F.col("eligible")
    return table.withColumn("selected", chosen)


def top_one(df: DataFrame, score: str, tiebreak: Sequence[str], user: str = "user_id") -> DataFrame:
    """Each user's best row, map-side combined."""
    others = [c for c in df.columns if c != user]
    # smallest tiebreak among the highest scores
    key = F.struct(-F.col(score), *[F.col(c) for c in tiebreak])
    best = df.groupBy(user).agg(F.min_by(F.struct(*others), key).alias("_r"))
    return best.select(user, "_r.*")


def coefficient_map(effects: DataFrame, stage: str, level: str = ALL) -> dict[str, tuple[float, float]]:
    """Estimable coefficients and errors of one stage and level (a result table of a few rows)."""
    rows = effects.filter(
        (F.col("stage") == stage) & (F.col("h_level") == level) & F.col("estimable") & F.col("coefficient").isNotNull()
    ).select("treatment", "coefficient", "std_error")
    return {r["treatment"]: (r["coefficient"], r["std_error"] or 0.0) for r in rows.collect()}


def lift_interval(selected: DataFrame, theta: Mapping[str, tuple[float, float]], reps: int = 1000, seed: int = 20260713):
    """Mean lift and its percentile interval over normal draws of the coefficients.

    The mean lift is linear in the coefficients, so the rows are read once for
    one mean per treatment and the draws happen on those means.
    """
    columns = list(theta)
    if not columns:
        return 0.0, 0.0, 0.0
    row = selected.agg(*[F.avg(safe_double(c, 0.0)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    means = np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))])
    center = np.array([theta[c][0] for c in columns])
    spread = np.array([max(0.0, theta[c][1] or 0.0) for c in columns])
    draws = np.random.default_rng(seed).normal(center, spread, size=(reps, len(columns))) @ means
    low, high = np.percentile(draws, [2.5, 97.5])
    return float(means @ center), float(low), float(high)


def policy_table(
    df: DataFrame,
    scores: Mapping[str, Column],
    theta: Mapping[str, tuple[float, float]],
    min_rows: int = 3,
    reps: int = 1000,
    reference: str | None = None,
) -> DataFrame:
    """Observed rates and mean lift of each policy's top choice per user."""
    # one row per user and one pass per policy follow
    df = stored(df)
    sizes = df.groupBy("user_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    eligible = df.join(sizes.select("user_id"), "user_id", "left_semi")
    total = eligible.count()
    rows = []
    for name, score in scores.items():
        chosen = top_one(eligible.withColumn("_score", score), "_score", ["item_id", "timestamp"])
        counts = chosen.agg(
            F.countDistinct("user_id").alias("u"),
            F.countDistinct("item_id").alias("i"),
            *[F.avg(f"y_{s}").alias(s) for s in STAGE_WEIGHTS],
        ).first()
        mean, low, high = lift_interval(chosen, theta, reps)
        rates = [float(counts[s] * 100) for s in STAGE_WEIGHTS]
        rows.append((name, counts["u"], counts["i"], *rates, mean, low, high, total))
    schema = (
        "policy string, users long, items long, click_rate double, cart_rate double, purchase_rate double, "
        "mean_lift double, lift_lower double, lift_upper double, candidate_rows long"
    )
    table = E.small_frame(df.sparkSession, rows, schema)
    if reference:
        base = table.filter(F.col("policy") == reference).select(F.col("purchase_rate").alias("_b"))
        table = table.crossJoin(F.broadcast(base)).withColumn("purchase_delta", F.col("purchase_rate") - F.col("_b"))
        table = table.drop("_b")
    return table


def policy_choices(df: DataFrame, parameters: DataFrame, treatments: Sequence[str], tiebreak: Sequence[str] = ("item_id", "timestamp"), user: str = "user_id") -> DataFrame:
    """Each user's best row under each policy: policy, user, the other columns.

    ``parameters`` (policy, treatment, coefficient) stays a table: one row holds all policies, so
    rows are scored and every policy's best row kept in the same pass, combined before the
    shuffle. Equal scores go to the smallest ``tiebreak``.
    """
    entries = F.map_from_entries(F.collect_list(F.struct("treatment", "coefficient")))
    each = parameters.filter(F.col("coefficient").isNotNull()).groupBy("policy").agg(entries.alias("weights"))
    all_of = each.agg(F.collect_list(F.struct("policy", "weights")).alias("_policies"))
    others = [c for c in df.columns if c != user]
    weight = lambda p, t: F.coalesce(F.try_element_at(p["weights"], F.lit(t)), F.lit(0.0))
    score = lambda p: functools.reduce(operator.add, [weight(p, t) * F.coalesce(safe_double(t), F.lit(0.0)) for t in treatments], F.lit(0.0))
    scored = F.transform("_policies", lambda p: F.struct(p["policy"].alias("policy"), score(p).alias("_score")))
    wide = df.crossJoin(F.broadcast(all_of)).select(user, *others, F.inline(scored))
    key = F.struct(-F.col("_score"), *[F.col(c) for c in tiebreak])
    return wide.groupBy("policy", user).agg(F.min_by(F.struct(*others), key).alias("_r")).select("policy", user, "_r.*")


def estimated_policies(df: DataFrame, parameters: DataFrame, theta: DataFrame, treatments: Sequence[str], min_rows: int = 3, reps: int = 1000, seed: int = 20260713) -> DataFrame:
    """Observed rates and mean lift, with its interval, of every policy's choices, in one pass over the rows.

    ``theta`` (treatment, coefficient, std_error) values the choices; its errors give the
    interval by normal draws on one mean per policy and treatment.
    """
    sizes = df.groupBy("user_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    eligible = df.join(sizes.select("user_id"), "user_id", "left_semi")
    chosen = policy_choices(eligible, parameters, treatments)
    rates = [(F.avg(f"y_{s}") * 100).alias(f"{s}_rate") for s in STAGE_WEIGHTS]
    means = F.array(*[F.avg(safe_double(t, 0.0)) for t in treatments]).alias("_means")
    table = chosen.groupBy("policy").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), *rates, means)
    order = {t: i for i, t in enumerate(treatments)}
    values = theta.filter(F.col("treatment").isin(list(treatments))).agg(F.collect_list(F.struct("treatment", "coefficient", "std_error")).alias("_theta"))
    total = eligible.agg(F.count("*").alias("candidate_rows"))
    wide = table.crossJoin(F.broadcast(values)).crossJoin(F.broadcast(total))
    shown = ["policy", "users", "items", *[f"{s}_rate" for s in STAGE_WEIGHTS]]

    def intervals(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                record = row._asdict() if "_means" in row._fields else dict(zip(pdf.columns, row, strict=True))
                center, spread = np.zeros(len(order)), np.zeros(len(order))
                for t in record["_theta"]:
                    center[order[t["treatment"]]] = t["coefficient"] or 0.0
                    spread[order[t["treatment"]]] = max(0.0, t["std_error"] or 0.0)
                at = np.array(record["_means"], float)
                draws = np.random.default_rng(seed).normal(center, spread, size=(reps, len(order))) @ at
                out.append((*[record[c] for c in shown], float(at @ center), *map(float, np.percentile(draws, [2.5, 97.5])), record["candidate_rows"]))
            yield pd.DataFrame(out, columns=[*shown, "mean_lift", "lift_lower", "lift_upper", "candidate_rows"])

    kinds = ", ".join(f"{s}_rate double" for s in STAGE_WEIGHTS)
    return wide.mapInPandas(intervals, f"policy string, users long, items long, {kinds}, mean_lift double, lift_lower double, lift_upper double, candidate_rows long")


def estimated_reranking(
    candidates: DataFrame,
    profiles: DataFrame,
    levels: DataFrame,
    residuals: DataFrame,
    outcomes: Sequence[str],
    heuristic: Sequence[str],
    analytical: Sequence[str],
    ts: str,
    weights: Sequence[float],
    retention: float,
    min_sign_agreement: float,
    min_correlation: float,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The chain from residuals to re-ranked candidates: (scores, prior, gates, weight table).

    ``candidates``: stage, user_id, item_id, is_target, relevance; ``profiles``: item_id and a
    column per cue name. Prior, gates and weights stay tables of a few rows; the score of a
    candidate uses the weight that its stage's table selects, 0 where none is eligible.
    """
    prior = cut(causal_prior(residuals, outcomes, heuristic, analytical))
    gates = cut(prior_stability(residuals, ts, outcomes, heuristic, analytical, min_sign_agreement, min_correlation))
    cues = [E.component(c) for c in [*heuristic, *analytical]]
    scored = stored(candidate_scores(candidates, profiles, levels, prior, cues).select("stage", "user_id", "item_id", "is_target", "relevance", "causal"))
    calibrations = calibration(scored)
    table = cut(select_weight(scored, calibrations, weights, gates, retention))
    chosen = table.filter("selected").select("stage", "weight")
    weighted = scored.join(F.broadcast(chosen), "stage", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return blend(weighted, calibrations, F.col("weight")), prior, gates, table
