"""Omitted-confounding bounds from long and short regressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.operators import effects as E
from funnelweir.operators.moments import ALL, CONST, Problem, moments, solve
from funnelweir.operators.resampling import wild_draws

CF_LIMIT = 1.0 - 1e-9


def benchmark_groups(columns: Sequence[str]) -> dict[str, list[str]]:
    """Covariates by what they stand for: price, position, user history."""
    rules = {
        "price": lambda c: "price" in c or "x_pri" in c,
        "position": lambda c: "position" in c or "x_pos" in c,
        "user_history": lambda c: "user_" in c and any(part in c for part in ("_pre", "tenure", "history")),
    }
    groups = {name: [c for c in columns if rule(c.lower())] for name, rule in rules.items()}
    return {name: members for name, members in groups.items() if members}


def elements(
    df: DataFrame,
    outcomes: Sequence[str],
    treatments: Sequence[str],
    reps: int = 0,
    seed: int = 0,
    cluster: str = "user_id",
) -> dict[tuple[str, str], dict]:
    """theta, residual variance and representer variance per (outcome, treatment).

    All come from cross products: the variance of a treatment given the others
    is one over n times the diagonal of the inverse. ``reps`` adds wild draws.
    """
    clean = E.numeric_columns(df, [*outcomes, *treatments])
    problems = [Problem(y, tuple(treatments), (y,)) for y in outcomes]
    found = moments(clean, problems)
    out = {}
    for i, y in enumerate(outcomes):
        cross = found[(ALL, y)]
        if cross.n <= len(treatments) + 5:
            raise ValueError(f"insufficient complete cases for {y}")
        fit = solve(cross, [CONST, *treatments], y)
        sigma2 = fit.sse / fit.n
        draws = wild_draws(clean, fit, treatments, reps, seed + 1000 * i, cluster) if reps else None
        for j, t in enumerate(treatments):
            p = fit.design.index(t)
            about = {"n": fit.n, "theta": float(fit.beta[p]), "sigma2": sigma2, "nu2": float(fit.n * fit.bread[p, p])}
            if draws:
                about.update(draws=draws[0][:, j], sigma2_draws=draws[1], nu2_draws=draws[2][:, j])
            out[(y, t)] = about
    return out


def gains(long: Mapping, short: Mapping) -> dict[str, float]:
    """Confounding strength of the covariates missing from the short design."""
    clip = lambda v, high=1.0: min(high, max(0.0, v))
    cf_y = clip((short["sigma2"] - long["sigma2"]) / long["sigma2"])
    ratio = short["nu2"] / long["nu2"]
    cf_d = clip((1.0 - ratio) / ratio) if ratio > 0 else 1.0
    delta = short["theta"] - long["theta"]
    scale = math.sqrt(max(0.0, short["sigma2"] - long["sigma2"]) * max(0.0, long["nu2"] - short["nu2"]))
    rho = clip(abs(delta) / scale) if scale > 0 else 1.0
    return {"cf_y": cf_y, "cf_d": cf_d, "rho": math.copysign(rho, delta) if delta else rho, "delta_theta": delta}


def strength(cf_y: float, cf_d: float) -> float:
    y, d = min(1.0, max(0.0, cf_y)), min(CF_LIMIT, max(0.0, cf_d))
    return math.sqrt(y * d / (1.0 - d))


def equal_strength(distance: float, scale: float) -> float:
    """The r with r / sqrt(1 - r) = distance / scale."""
    if not (math.isfinite(distance) and math.isfinite(scale)) or scale <= 0:
        return float("nan")
    square = max(0.0, distance / scale) ** 2
    return min(1.0, max(0.0, (math.sqrt(square * square + 4.0 * square) - square) / 2.0))


GAIN_SCHEMA = (
    "stage string, treatment string, benchmark string, long_theta double, short_theta double, "
    "delta_theta double, cf_y double, cf_d double, rho double"
)
BOUND_SCHEMA = (
    "stage string, treatment string, n long, theta double, ci_lower double, ci_upper double, benchmark string, "
    "multiplier int, cf_y double, cf_d double, bias double, adjusted double, adjusted_lower double, "
    "adjusted_upper double, point_value double, interval_value double"
)


def bounds(
    long_frame: DataFrame,
    short_frames: Mapping[str, DataFrame],
    outcomes: Sequence[str],
    treatments: Sequence[str],
    reps: int = 1000,
    seed: int = 20260717,
    multipliers: Sequence[int] = (0, 1, 2, 3),
) -> tuple[DataFrame, DataFrame]:
    """Benchmark gains and bias-adjusted estimates: (gain rows, bound rows).

    ``short_frames`` hold the same residual columns refitted without one
    covariate group each; the strongest group sets the unit of strength.
    """
    spark = long_frame.sparkSession
    long = elements(long_frame, outcomes, treatments, reps, seed)
    gain_rows, strongest = [], {}
    for name, frame in short_frames.items():
        short = elements(frame, outcomes, treatments)
        for key, about in long.items():
            g = gains(about, short[key])
            y, t = key
            gain_rows.append(
                (E._stage(y), E.component(t), name, about["theta"], short[key]["theta"], g["delta_theta"], g["cf_y"],
                 g["cf_d"], g["rho"])
            )
            power = strength(g["cf_y"], g["cf_d"])
            if key not in strongest or power > strongest[key][0]:
                strongest[key] = (power, name, g)
    rows = []
    for (y, t), about in long.items():
        _, name, g = strongest[(y, t)]
        low, high = np.percentile(about["draws"], [2.5, 97.5])
        scale = math.sqrt(about["sigma2"] * about["nu2"])
        away = low if low > 0 else (-high if high < 0 else 0.0)
        direction = math.copysign(1.0, about["theta"]) if about["theta"] else 1.0
        for m in multipliers:
            cf_y, cf_d = min(1.0, m * g["cf_y"]), min(CF_LIMIT, m * g["cf_d"])
            power = strength(cf_y, cf_d)
            shifted = about["draws"] - direction * np.sqrt(about["sigma2_draws"] * about["nu2_draws"]) * power
            a, b = np.percentile(shifted, [2.5, 97.5])
            rows.append(
                (E._stage(y), E.component(t), about["n"], about["theta"], float(low), float(high), name, m, cf_y, cf_d,
                 scale * power, about["theta"] - direction * scale * power, float(a), float(b),
                 equal_strength(abs(about["theta"]), scale), equal_strength(float(away), scale))
            )
    return E.small_frame(spark, gain_rows, GAIN_SCHEMA), E.small_frame(spark, rows, BOUND_SCHEMA)


def classify_bounds(table: DataFrame) -> DataFrame:
    """Status of each bound; boundary rows carry no numeric effect."""
    reference = F.col("multiplier") == 0
    boundary = ~reference & (F.col("cf_d") >= 1.0 - 1e-8)
    zero_gain = boundary & (F.col("cf_y") <= 1e-12)
    status = (
        F.when(reference, "REFERENCE")
        .when(zero_gain, "NONINFORMATIVE_ZERO_OUTCOME_GAIN")
        .when(boundary, "UNBOUNDED_CF_D_BOUNDARY")
        .otherwise("FINITE")
    )
    out = table.withColumn("bound_status", status)
    shown = F.col("bound_status").isin("FINITE", "REFERENCE")
    out = out.withColumns(
        {f"bounded_{c}": F.when(shown, F.col(c)) for c in ("adjusted", "adjusted_lower", "adjusted_upper")}
    )
    same = F.when(F.col("theta") != 0, F.signum("theta") == F.signum("bounded_adjusted"))
    clear = F.when(F.col("theta") > 0, F.col("bounded_adjusted_lower") > 0).when(
        F.col("theta") < 0, F.col("bounded_adjusted_upper") < 0
    )
    conclusion = (
        F.when(reference, "UNADJUSTED_REFERENCE")
        .when(zero_gain, "BENCHMARK_NOT_INFORMATIVE_FOR_BIAS_BOUND")
        .when(boundary, "ADVERSARIAL_BOUND_NOT_FINITE")
        .when(F.coalesce(same, F.lit(False)), "POINT_DIRECTION_PRESERVED")
        .otherwise("FINITE_BOUND_CROSSES_ZERO")
    )
    return out.withColumns(
        {"point_direction_preserved": same, "interval_clear_of_zero": clear, "conclusion": conclusion}
    )


def focal_summary(classified: DataFrame, focal: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per focal (stage, treatment) with the bound and conclusion at each multiplier."""
    keep = F.lit(False)
    for stage, treatment in focal:
        keep = keep | ((F.lower("stage") == stage) & (F.col("treatment") == treatment))
    chosen = classified.filter(keep)
    at = lambda m, c: F.max(F.when(F.col("multiplier") == m, F.col(c)))
    return chosen.groupBy("stage", "treatment", "benchmark").agg(
        F.max("theta").alias("theta"),
        (100.0 * F.max("point_value")).alias("point_percent"),
        (100.0 * F.max("interval_value")).alias("interval_percent"),
        *[at(m, "bounded_adjusted").alias(f"adjusted_at_{m}x") for m in (1, 2, 3)],
        *[at(m, "conclusion").alias(f"conclusion_at_{m}x") for m in (1, 2, 3)],
    )
