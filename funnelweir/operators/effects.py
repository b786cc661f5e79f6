"""Support gates, effect families and tests on residual tables."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelweir.functions.scalars import safe_double
from funnelweir.functions.tails import chi2_sf, normal_quantile, normal_two_sided
from funnelweir.operators.moments import ALL, Fit, Problem, cluster_errors, moments, robust_errors, solve
from funnelweir.operators.ordering import exact_quantiles

# fixed values: support thresholds, checked in this order
MIN_N, MIN_SD, MIN_IQR, MIN_BINS = 500, 0.02, 0.02, 4
BINS = 10
# fixed values: cues by pathway
HEURISTIC_CUES = ["T_con_mkt", "T_con_soc", "T_con_rat", "a_pri", "a_gft", "a_sub", "a_urg"]
ANALYTICAL_CUES = ["T_int_fac", "T_int_vis", "T_int_sem", "a_spec", "a_str"]
CUE_FAMILIES = {
    "MNC_marketing_components": ["a_pri", "a_gft", "a_sub", "a_urg"],
    "MAI_functional_visual_components": ["a_spec", "a_str"],
}


def component(column: str) -> str:
    """Short cue name of a treatment column."""
    name = column
    for mark in ("res_", "__reverse_gs_pure", "__gs_pure", "_calibrated", "_calib", "atomic_"):
        name = name.replace(mark, "")
    return "a_pri" if name == "mkt_price" else name


def pathway(cue: str) -> str:
    if cue in HEURISTIC_CUES:
        return "MNC"
    if cue in ANALYTICAL_CUES:
        return "MAI"
    raise ValueError(f"unknown cue {cue}")


def small_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Result table of bounded size; NaN becomes NULL."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    clean = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    return spark.createDataFrame(clean, schema) if clean else spark.createDataFrame(pd.DataFrame(columns=names), schema)


def histogram_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """Equal-width bins over each column's range: by, name, effective_bins, min_bin_count, max_bin_share.

    Ranges come first, as one row per level; bins are then counted in one scan.
    """
    ranges = df.groupBy(*by).agg(
        *[f(c).alias(f"_{side}{i}") for i, c in enumerate(columns) for side, f in (("a", F.min), ("b", F.max))]
    )
    if by:
        on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
        wide = df.alias("l").join(F.broadcast(ranges).alias("r"), on)
    else:
        wide = df.alias("l").crossJoin(F.broadcast(ranges).alias("r"))
    lines = []
    for i, c in enumerate(columns):
        x, low, high = F.col(f"l.{c}").cast("double"), F.col(f"r._a{i}"), F.col(f"r._b{i}")
        place = F.coalesce(F.floor(F.try_divide(x - low, high - low) * bins), F.lit(0))
        lines.append(F.struct(F.lit(c).alias("name"), F.when(x.isNotNull(), F.least(F.lit(bins - 1), place)).alias("_bin")))
    binned = wide.select(*[F.col(f"l.{k}").alias(k) for k in by], F.inline(F.array(*lines))).filter("_bin IS NOT NULL")
    counts = binned.groupBy(*by, "name", "_bin").agg(F.count("*").alias("_c"))
    return counts.groupBy(*by, "name").agg(
        F.count("*").alias("effective_bins"),
        F.min("_c").alias("min_bin_count"),
        (F.max("_c") / F.sum("_c")).alias("max_bin_share"),
    )


SUPPORT_SCHEMA = (
    "treatment string, support_n long, residual_sd double, residual_iqr double, residual_width double, "
    "effective_bins long, min_bin_count long, max_bin_share double, support_flag string, estimable boolean"
)


def support(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    min_n: int = MIN_N,
    min_sd: float = MIN_SD,
    min_iqr: float = MIN_IQR,
    min_bins: int = MIN_BINS,
) -> DataFrame:
    """One row per column (and level of ``by``) with spread, bins and the gate decision."""
    ids = [*by, "name"]
    clean = df.select(*by, *[safe_double(c).alias(c) for c in columns])
    # several scans follow; a frame the caller has cached is not cached again
    own_cache = not df.is_cached
    if own_cache:
        clean = clean.persist()
    spread = clean.groupBy(*by).agg(
        *[f(c).alias(f"{side}{i}") for i, c in enumerate(columns) for side, f in (("n", F.count), ("sd", F.stddev))]
    )
    # every part holds a few numbers per level and column
    parts: dict[tuple, dict] = {}
    for r in spread.collect():
        for i, c in enumerate(columns):
            if r[f"n{i}"]:
                parts[(*[r[k] for k in by], c)] = {"n": r[f"n{i}"], "sd": r[f"sd{i}"]}
    for table in (
        exact_quantiles(clean, columns, [0.25, 0.75, 0.01, 0.99], by),
        histogram_stats(clean, columns, by),
    ):
        for r in table.collect():
            parts.setdefault(tuple(r[c] for c in ids), {}).update(r.asDict())
    levels = [tuple(r) for r in clean.select(*by).distinct().collect()] if by else [()]
    if own_cache:
        clean.unpersist()
    nan = float("nan")
    rows = []
    for level in levels:
        for c in columns:
            s = parts.get((*level, c))
            if s is None:
                rows.append((*level, c, 0, nan, nan, nan, 0, 0, nan, "empty_treatment_residual", False))
                continue
            sd, iqr, width = s["sd"] or 0.0, s["p1"] - s["p0"], s["p3"] - s["p2"]
            checks = {
                "small_n": s["n"] < min_n,
                "low_residual_sd": sd < min_sd,
                "low_residual_iqr": iqr < min_iqr,
                "sparse_effective_bins": s["effective_bins"] < min_bins,
            }
            reasons = "|".join(name for name, failed in checks.items() if failed)
            rows.append(
                (*level, c, s["n"], sd, iqr, width, s["effective_bins"], s["min_bin_count"], s["max_bin_share"],
                 reasons or "ok", not reasons)
            )
    kinds = "".join(f"{n} {t}, " for n, t in clean.select(*by).dtypes) if by else ""
    return small_frame(df.sparkSession, rows, kinds + SUPPORT_SCHEMA)


def support_table(df: DataFrame, columns: Sequence[str], by: str | None = None, **limits) -> dict[tuple[str, str], dict]:
    """Gate rows on the driver keyed by (level, column); levels include ``ALL``."""
    if not by:
        return {(ALL, r["treatment"]): r.asDict() for r in support(df, columns, **limits).collect()}
    # the whole frame is one more level, so both come from the same scans
    level = F.explode(F.array(F.lit(ALL), F.concat(F.lit("="), F.col(by).cast("string"))))
    both = df.select(level.alias("_level"), *columns).filter("_level IS NOT NULL")
    rows = support(both, columns, ["_level"], **limits).collect()
    return {(r["_level"] if r["_level"] == ALL else r["_level"][1:], r["treatment"]): r.asDict() for r in rows}


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: safe_double(c) for c in dict.fromkeys(columns)})


@contextlib.contextmanager
def held(df: DataFrame, numbers: Sequence[str], keys: Sequence[str]):
    """The needed columns, cached while several passes read them; results leave as small tables."""
    frame = numeric_columns(df.select(*dict.fromkeys([*keys, *numbers])), numbers).persist()
    try:
        yield frame
    finally:
        frame.unpersist()


EFFECT_SCHEMA = (
    "h_level string, stage string, component string, treatment string, coefficient double, std_error double, "
    "ci_lower double, ci_upper double, z double, p_value double, n long, covariance string, "
    "support_n long, residual_sd double, residual_iqr double, support_flag string, estimable boolean"
)


def _stage(outcome: str) -> str:
    return outcome.replace("res_y_", "").replace("y_", "")


def _line(fit: Fit, name: str) -> tuple:
    value, error = fit.coefficient(name), fit.error(name)
    z = value / error if error and error > 0 else float("nan")
    p = normal_two_sided(z) if math.isfinite(z) else float("nan")
    return value, error, value - 1.96 * error, value + 1.96 * error, z, p


def fit_designs(
    df: DataFrame,
    problems: Sequence[Problem],
    by: str | None = None,
    only: Mapping[str, Sequence[str]] | None = None,
) -> list[Fit]:
    """Least squares for every problem (its single y) and level with enough complete rows."""
    found = moments(df, problems, by)
    fits = []
    for (level, name), cross in sorted(found.items()):
        if only is not None and level not in only.get(name, ()):
            continue
        p = next(q for q in problems if q.name == name)
        if cross.n <= len(p.x) + 5:
            continue
        fits.append(solve(cross, p.design, p.y[0], name=name, level=level, by=by, weight=p.weight))
    return fits


def set_fits(
    df: DataFrame,
    outcomes: Sequence[str],
    sets: Mapping[str, Sequence[str]],
    gates: Mapping[tuple[str, str], dict],
    by: str | None = None,
    user: str = "user_id",
    item: str | None = "item_id",
    errors: str = "cluster",
) -> dict[tuple[str, str, str], Fit]:
    """Joint regressions of each outcome on the estimable treatments of each set, per level: {(set, level, outcome): fit}.

    All of them are fitted in the same passes.
    """
    clean = numeric_columns(df, [*outcomes, *[t for treatments in sets.values() for t in treatments]])
    problems, only, owner = [], {}, {}
    for key, treatments in sets.items():
        wanted: dict[tuple[str, ...], list[str]] = {}
        for level in sorted({lv for lv, _ in gates}):
            passed = tuple(t for t in treatments if gates[(level, t)]["estimable"])
            if passed:
                wanted.setdefault(passed, []).append(level)
        for i, (passed, levels) in enumerate(wanted.items()):
            for y in outcomes:
                name = f"{key}|{i}|{y}"
                problems.append(Problem(name, passed, (y,)))
                only[name], owner[name] = levels, key
    if not problems:
        return {}
    fits = fit_designs(clean, problems, by, only)
    if errors == "cluster":
        cluster_errors(clean, fits, user, item)
    elif errors == "hc1":
        robust_errors(clean, fits)
    return {(owner[f.name], f.level, f.y): f for f in fits}


def family_fits(
    df: DataFrame,
    outcomes: Sequence[str],
    treatments: Sequence[str],
    gates: Mapping[tuple[str, str], dict],
    by: str | None = None,
    user: str = "user_id",
    item: str | None = "item_id",
    errors: str = "cluster",
) -> dict[tuple[str, str], Fit]:
    """:func:`set_fits` of one set: {(level, outcome): fit}."""
    return {(level, y): f for (_, level, y), f in set_fits(df, outcomes, {"": treatments}, gates, by, user, item, errors).items()}


def families(
    df: DataFrame,
    outcomes: Sequence[str],
    sets: Mapping[str, Sequence[str]],
    by: str | None = None,
    user: str = "user_id",
    item: str | None = "item_id",
    limits: Mapping | None = None,
    errors: str = "cluster",
) -> dict[str, DataFrame]:
    """:func:`family` of several treatment sets on the same rows, held once and fitted in the same passes."""
    union = list(dict.fromkeys(t for treatments in sets.values() for t in treatments))
    with held(df, [*outcomes, *union], [c for c in (by, user, item) if c]) as frame:
        gates = support_table(frame, union, by, **(limits or {}))
        fits = set_fits(frame, outcomes, sets, gates, by, user, item, errors)
    out = {}
    for key, treatments in sets.items():
        rows = []
        for level in sorted({lv for lv, _ in gates}):
            for y in outcomes:
                fit = fits.get((key, level, y))
                for t in treatments:
                    g = gates[(level, t)]
                    about = (g["support_n"], g["residual_sd"], g["residual_iqr"], g["support_flag"], g["estimable"])
                    head = (level, _stage(y), component(t), t)
                    if fit is None or t not in fit.names:
                        rows.append((*head, *[float("nan")] * 6, 0, "not_estimated", *about))
                    else:
                        rows.append((*head, *_line(fit, t), fit.n, fit.kind, *about))
        out[key] = small_frame(df.sparkSession, rows, EFFECT_SCHEMA)
    return out


def family(
    df: DataFrame,
    outcomes: Sequence[str],
    treatments: Sequence[str],
    by: str | None = None,
    user: str = "user_id",
    item: str | None = "item_id",
    limits: Mapping | None = None,
    errors: str = "cluster",
) -> DataFrame:
    """Gate, joint regression and one row per (level, outcome, treatment), skipped ones included."""
    return families(df, outcomes, {"": treatments}, by, user, item, limits, errors)[""]


def wald(fit: Fit, names: Sequence[str]) -> dict:
    """Joint chi-square test that the named combinations are zero; df is the covariance rank."""
    index = [fit.names.index(c) for c in names]
    value = fit.values[index]
    cov = fit.covariance[np.ix_(index, index)]
    if not np.isfinite(cov).all():
        return {"statistic": float("nan"), "df": len(index), "df_nominal": len(index), "p_value": float("nan")}
    rank = int(np.linalg.matrix_rank(cov))
    statistic = float(value @ np.linalg.pinv(cov, hermitian=True) @ value)
    df = max(1, rank or len(index))
    return {"statistic": statistic, "df": df, "df_nominal": len(index), "p_value": chi2_sf(statistic, df)}


def contrast(fit: Fit, weights: Mapping[str, float]) -> tuple[float, float, float, float]:
    """Estimate, standard error, z and two-sided p of a weighted sum of reported combinations."""
    vector = np.zeros(len(fit.names))
    for name, weight in weights.items():
        vector[fit.names.index(name)] = weight
    estimate = float(vector @ fit.values)
    error = math.sqrt(max(0.0, float(vector @ fit.covariance @ vector)))
    z = estimate / error if error > 0 else float("nan")
    return estimate, error, z, normal_two_sided(z) if math.isfinite(z) else float("nan")


MODERATION_SCHEMA = (
    "stage string, component string, treatment string, test string, reference string, estimate double, "
    "std_error double, statistic double, df int, p_value double, n long, status string"
)


def moderation(
    df: DataFrame,
    outcomes: Sequence[str],
    treatments: Sequence[str],
    level: str = "H_level",
    semantic: str | None = None,
    observed_only: bool = False,
    user: str = "user_id",
    item: str | None = "item_id",
    limits: Mapping | None = None,
) -> DataFrame:
    """Slope differences between history levels per treatment, with an omnibus row.

    ``semantic`` names a treatment without values at level 0: it is zero-filled
    with an availability column and its slopes are compared among the levels
    that have it. ``observed_only`` builds levels from the data instead of 0..3.
    """
    df = numeric_columns(df.select(*[c for c in (user, item) if c], level, *outcomes, *treatments), [*outcomes, *treatments])
    df = df.persist()
    gates = support_table(df, treatments, **(limits or {}))
    passed = [t for t in treatments if gates[(ALL, t)]["estimable"]]
    semantic = semantic if semantic in passed else None
    clean = df
    h = F.coalesce(safe_double(level), F.lit(0.0)).cast("int") if not observed_only else safe_double(level).cast("int")
    clean = clean.withColumn("_h", h)
    if observed_only:
        seen = [r["_h"] for r in clean.select("_h").distinct().collect() if r["_h"] is not None]
        levels = sorted(seen)
    else:
        levels = [0, 1, 2, 3]
    semantic_levels = [k for k in levels if k != 0] if not observed_only else []
    if observed_only and semantic:
        rows = clean.filter(F.col(semantic).isNotNull()).select("_h").distinct().collect()
        semantic_levels = sorted(r["_h"] for r in rows if r["_h"] is not None)
    base = levels[0] if levels else 0
    added = {f"_lv{k}": (F.col("_h") == k).cast("double") for k in levels if k != base}
    for t in passed:
        filled = F.coalesce(F.col(t), F.lit(0.0))
        for k in levels:
            added[f"{t}__at{k}"] = filled * (F.col("_h") == k).cast("double")
    if semantic:
        added["_has_semantic"] = F.col(semantic).isNotNull().cast("double")
        added["_sem0"] = F.coalesce(F.col(semantic), F.lit(0.0))
    wide = clean.withColumns(added)
    plain = [t for t in passed if t != semantic]
    shared = [*plain, *(["_has_semantic"] if semantic else []), *[f"_lv{k}" for k in levels if k != base]]
    problems, plans, skipped = [], {}, []
    for t in treatments:
        usable = semantic_levels if t == semantic else levels
        if t not in passed:
            skipped.append((t, "N/A: treatment support gate failed"))
            continue
        if len(usable) < 2:
            skipped.append((t, "N/A: fewer than two estimable H levels"))
            continue
        reference = 0 if t != semantic and 0 in usable else usable[0]
        others = [k for k in usable if k != reference]
        if t == semantic:
            design = (*shared, *[f"{t}__at{k}" for k in usable])
            tests = {f"H{k}-H{reference}": {f"{t}__at{k}": 1.0, f"{t}__at{reference}": -1.0} for k in others}
        else:
            design = (*shared, *(["_sem0"] if semantic else []), *[f"{t}__at{k}" for k in others])
            tests = {f"H{k}-H{reference}": {f"{t}__at{k}": 1.0} for k in others}
        for y in outcomes:
            name = f"{t}|{y}"
            problems.append(Problem(name, design, (y,)))
            plans[name] = (t, y, reference, tests)
    fits = fit_designs(wide, problems) if problems else []
    for fit in fits:
        fit.report(plans[fit.name][3])
    cluster_errors(clean, fits, user, item, lambda rows: rows.withColumns(added))
    df.unpersist()
    rows = []
    for fit in fits:
        t, y, reference, tests = plans[fit.name]
        head = (_stage(y), component(t), t)
        for name in tests:
            value, error, _, _, z, p = _line(fit, name)
            rows.append((*head, name, f"H{reference}", value, error, z, 1, p, fit.n, "estimated"))
        joint = wald(fit, list(tests))
        rows.append(
            (*head, "omnibus", f"H{reference}", float("nan"), float("nan"), joint["statistic"], joint["df"],
             joint["p_value"], fit.n, "estimated")
        )
    for t, reason in skipped:
        for y in outcomes:
            rows.append((_stage(y), component(t), t, "omnibus", reason, *[float("nan")] * 3, None, float("nan"), 0,
                         "not_estimated"))
    return small_frame(df.sparkSession, rows, MODERATION_SCHEMA)


def stage_contrasts(
    df: DataFrame,
    stage_outcomes: Mapping[str, str],
    treatments: Sequence[str],
    user: str = "user_id",
    item: str | None = "item_id",
    limits: Mapping | None = None,
) -> DataFrame:
    """Effects on each stage and on every later-minus-earlier stage difference, from one scan."""
    stages = list(stage_outcomes)
    wide, outcomes, kinds = df, {}, {}
    for s in stages:
        outcomes[s], kinds[s] = stage_outcomes[s], "stage_effect"
    for i, early in enumerate(stages):
        for late in stages[i + 1 :]:
            name = f"_diff_{late}_{early}"
            wide = wide.withColumn(name, safe_double(stage_outcomes[late]) - safe_double(stage_outcomes[early]))
            outcomes[f"{late}-{early}"], kinds[f"{late}-{early}"] = name, "stage_difference"
    with held(wide, [*outcomes.values(), *treatments], [c for c in (user, item) if c]) as frame:
        gates = support_table(frame, treatments, **(limits or {}))
        fits = family_fits(frame, list(outcomes.values()), treatments, gates, None, user, item)
    rows = []
    for label, y in outcomes.items():
        fit = fits.get((ALL, y))
        for t in treatments:
            ok = fit is not None and t in fit.names
            line = _line(fit, t) if ok else tuple([float("nan")] * 6)
            rows.append((kinds[label], label, component(t), t, *line, fit.n if ok else 0, ok))
    schema = (
        "test_type string, stage string, component string, treatment string, coefficient double, std_error double, "
        "ci_lower double, ci_upper double, z double, p_value double, n long, estimable boolean"
    )
    return small_frame(df.sparkSession, rows, schema)


def stage_patterns(tests: DataFrame, early: str = "click", late: str = "purchase", by: Sequence[str] = ("component",)):
    """Pattern label per cue from the two endpoint effects and their difference.

    ``tests`` has stage, coefficient, p_holm and estimable.
    """
    difference = f"{late}-{early}"
    wide = tests.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("stage") == s, F.col(c))).alias(f"{tag}_{c}")
            for s, tag in ((early, "early"), (late, "late"), (difference, "diff"))
            for c in ("coefficient", "p_holm", "estimable")
        ]
    )
    sure = lambda tag: F.coalesce(F.col(f"{tag}_p_holm") < 0.05, F.lit(False))
    a, b = F.col("early_coefficient"), F.col("late_coefficient")
    usable = F.col("early_estimable") & F.col("late_estimable") & F.col("diff_estimable")
    label = (
        F.when(~usable, "not_estimable_support_gate")
        .when((a * b < 0) & sure("early") & sure("late") & sure("diff"), "strict_reversal")
        .when(a * b < 0, "suggestive_reversal")
        .when(~sure("early") & sure("late") & sure("diff"), "purchase_stage_emergence")
        .when((F.signum(a) == F.signum(b)) & sure("diff") & (F.abs(b) < F.abs(a)), "significant_attenuation")
        .when(~sure("early") & ~sure("late"), "no_reliable_endpoint_effect")
        .otherwise("stable_or_other_stage_pattern")
    )
    present = F.col("early_estimable").isNotNull() & F.col("late_estimable").isNotNull() & F.col("diff_estimable").isNotNull()
    shown = lambda c: F.when(usable, F.col(c))
    return wide.filter(present).select(
        *by,
        shown("early_coefficient").alias("early_estimate"),
        shown("early_p_holm").alias("early_p_holm"),
        shown("late_coefficient").alias("late_estimate"),
        shown("late_p_holm").alias("late_p_holm"),
        shown("diff_coefficient").alias("late_minus_early"),
        shown("diff_p_holm").alias("difference_p_holm"),
        label.alias("pattern"),
    )


def joint_tests(fits: Mapping[tuple[str, str], Fit], families: Mapping[str, Sequence[str]] | None = None) -> list[tuple]:
    """Wald rows per outcome: all cues, each pathway, each cue family."""
    rows = []
    for (level, y), fit in fits.items():
        cues = {t: component(t) for t in fit.names}
        scopes = [("global", "All", list(cues))]
        for side in ("MNC", "MAI"):
            scopes.append(("pathway", side, [t for t, c in cues.items() if pathway(c) == side]))
        for name, members in (families or {}).items():
            scopes.append(("family", name, [t for t, c in cues.items() if c in members]))
        for scope, name, members in scopes:
            if members:
                w = wald(fit, members)
                rows.append(
                    (level, _stage(y), scope, name, w["statistic"], w["df"], w["df_nominal"], w["p_value"],
                     len(members), "|".join(cues[t] for t in members), fit.n)
                )
    return rows


JOINT_SCHEMA = (
    "h_level string, stage string, test_scope string, pathway string, statistic double, df int, df_nominal int, "
    "p_value double, cue_count int, components string, n long"
)


def precision(effects: DataFrame, power: float = 0.80, alpha: float = 0.05) -> DataFrame:
    """Minimum detectable effect and interquartile-range effect per estimated row."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    mde = F.lit(z) * F.col("std_error")
    return effects.filter(F.col("coefficient").isNotNull()).withColumns(
        {
            "absolute_effect": F.abs("coefficient"),
            "mde": mde,
            "effect_to_mde": F.try_divide(F.abs("coefficient"), mde),
            "iqr_effect_pp": F.col("coefficient") * F.col("residual_iqr") * 100.0,
            "mde_iqr_pp": mde * F.col("residual_iqr") * 100.0,
        }
    )


def robustness_value(effects: DataFrame, parameters: int = 1) -> DataFrame:
    """Partial strength a confounder needs to bring the estimate to zero, from t and degrees of freedom."""
    dof = F.greatest(F.lit(1.0), F.col("n") - F.lit(float(parameters)))
    f = F.abs(F.col("z")) / F.sqrt(dof)
    f2 = f * f
    value = 0.5 * (F.sqrt(f2 * f2 + 4 * f2) - f2)
    return effects.withColumns({"dof": dof, "robustness_value": F.when(F.col("z").isNotNull(), value)})


def support_consistent(results: DataFrame, gate: DataFrame, key: str = "treatment") -> DataFrame:
    """Keep or exclude each result row by its treatment's gate, with the reason."""
    joined = results.join(gate.select(key, "estimable", "support_flag"), key, "left")
    kept = F.coalesce(F.col("estimable"), F.lit(False))
    return joined.withColumns(
        {
            "decision": F.when(kept, "keep").otherwise("exclude"),
            "reason": F.when(kept, "support gate passed").otherwise(
                F.coalesce(F.col("support_flag"), F.lit("no gate result"))
            ),
        }
    )


def iqr_effects(df: DataFrame, columns: Sequence[str], results: DataFrame, key: str = "treatment") -> DataFrame:
    """Effect of moving each treatment across its interquartile range on the complete cases."""
    complete = numeric_columns(df, columns).dropna(subset=list(columns))
    n = complete.agg(F.count("*").alias("analysis_n"))
    spread = exact_quantiles(complete, columns, [0.25, 0.75]).select(
        F.col("name").alias(key), (F.col("p1") - F.col("p0")).alias("analysis_iqr")
    )
    scaled = results.join(F.broadcast(spread), key).crossJoin(F.broadcast(n))
    return scaled.withColumns(
        {
            "iqr_effect_pp": F.col("coefficient") * F.col("analysis_iqr") * 100.0,
            "iqr_ci_lower_pp": F.col("ci_lower") * F.col("analysis_iqr") * 100.0,
            "iqr_ci_upper_pp": F.col("ci_upper") * F.col("analysis_iqr") * 100.0,
            "n_match": F.col("n") == F.col("analysis_n"),
        }
    )


def specification_comparison(full: DataFrame, reduced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sign and significance stability between two result tables with coefficient, p_holm, n."""
    named = lambda d, s: d.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("coefficient", "p_holm", "n")])
    both = named(full, "primary").join(named(reduced, "full"), list(keys))
    change = F.col("coefficient_full") - F.col("coefficient_primary")
    sure = lambda s: F.coalesce(F.col(f"p_holm_{s}") < 0.05, F.lit(False))
    same = F.signum("coefficient_primary") == F.signum("coefficient_full")
    return both.withColumns(
        {
            "coefficient_change": change,
            "relative_change": F.try_divide(F.abs(change), F.abs("coefficient_primary")),
            "sign_stable": F.coalesce(same, F.lit(False)),
            "significance_stable": sure("primary") == sure("full"),
        }
    )


def sign_concordance(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of equal signs and correlation between two coefficient columns."""
    both = left.select(*keys, F.col("coefficient").alias("_a")).join(
        right.select(*keys, F.col("coefficient").alias("_b")), list(keys)
    )
    both = both.filter("_a IS NOT NULL AND _b IS NOT NULL")
    return both.groupBy(*by).agg(
        F.count("*").alias("pairs"),
        F.avg((F.signum("_a") == F.signum("_b")).cast("double")).alias("sign_concordance"),
        F.corr("_a", "_b").alias("coefficient_correlation"),
    )


def sign_stability(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Range and sign agreement of one cue over several specifications."""
    return results.filter(F.col("coefficient").isNotNull()).groupBy(*by).agg(
        F.count("*").alias("specifications"),
        F.min("coefficient").alias("min_coefficient"),
        F.max("coefficient").alias("max_coefficient"),
        F.count_if(F.col("coefficient") > 0).alias("positive"),
        (F.abs(F.sum(F.signum("coefficient"))) == F.count("*")).alias("sign_stable"),
    )


def stabilized_weights(
    df: DataFrame, treatment: str, prediction: str, training_sd: float, trim: float = 0.995, out: str = "gps_weight"
) -> DataFrame:
    """Continuous-treatment weights: marginal over conditional normal density, capped, mean one."""
    clean = numeric_columns(df, [treatment, prediction]).dropna(subset=[treatment, prediction])
    row = clean.agg(F.avg(treatment).alias("m"), F.stddev(treatment).alias("s")).first()
    if not row["s"] or row["s"] <= 1e-8 or training_sd <= 1e-8:
        raise ValueError("insufficient treatment variance")

    def log_density(x, mean, sd):
        z = (x - mean) / F.lit(float(sd))
        return -0.5 * z * z - F.lit(math.log(sd))

    t = F.col(treatment)
    ratio = log_density(t, F.lit(row["m"]), row["s"]) - log_density(t, F.col(prediction), training_sd)
    raw = F.exp(F.least(F.lit(20.0), F.greatest(F.lit(-20.0), ratio)))
    weighted = clean.withColumn("_w", raw)
    cap = exact_quantiles(weighted, ["_w"], [trim]).first()["p0"]
    capped = weighted.withColumn("_w", F.least(F.col("_w"), F.lit(float(cap))))
    mean = capped.agg(F.avg("_w")).first()[0]
    return capped.withColumn(out, F.col("_w") / F.lit(max(float(mean), 1e-12))).drop("_w")


def weight_summary(df: DataFrame, weight: str) -> DataFrame:
    w = F.col(weight)
    basic = df.agg(
        F.avg(w).alias("weight_mean"),
        F.max(w).alias("weight_max"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_sample_size"),
    )
    p99 = exact_quantiles(df, [weight], [0.99]).select(F.col("p0").alias("weight_p99"))
    return basic.crossJoin(F.broadcast(p99))


def weighted_effects(
    df: DataFrame,
    outcomes: Sequence[str],
    treatments: Sequence[str],
    weight: str | None = None,
    user: str = "user_id",
    item: str | None = "item_id",
) -> DataFrame:
    """Joint (weighted) least squares without a support gate."""
    problems = [Problem(y, tuple(treatments), (y,), weight=weight) for y in outcomes]
    numbers = [*outcomes, *treatments, *([weight] if weight else [])]
    with held(df, numbers, [c for c in (user, item) if c]) as clean:
        fits = fit_designs(clean, problems)
        cluster_errors(clean, fits, user, item)
    rows = [(_stage(f.y), component(t), t, *_line(f, t), f.n, f.kind) for f in fits for t in treatments]
    schema = (
        "stage string, component string, treatment string, coefficient double, std_error double, ci_lower double, "
        "ci_upper double, z double, p_value double, n long, covariance string"
    )
    return small_frame(df.sparkSession, rows, schema)
