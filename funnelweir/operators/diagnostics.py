"""Transport, calibration, support and rank diagnostics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.functions.scalars import safe_double
from funnelweir.operators import effects as E
from funnelweir.operators.moments import ALL, Cross, Problem, correlation, moments
from funnelweir.operators.nuisance import auc
from funnelweir.operators.ordering import exact_quantiles, quantile_edges, right_closed_bin

# fixed values: smallest rows and spread of a supported stratum
STRATUM_MIN_N, STRATUM_MIN_IQR = 100, 0.01
PROBABILITY_FLOOR = 1e-6


def _probability(c):
    return F.least(F.lit(1 - PROBABILITY_FLOOR), F.greatest(F.lit(PROBABILITY_FLOOR), c))


def expected_calibration_error(df: DataFrame, label: str, prediction: str, bins: int = 10) -> DataFrame:
    """Row-weighted gap of observed and predicted rates over equal-frequency bins (one row)."""
    edges = quantile_edges(df, [prediction], bins).get(prediction, [])
    binned = df.withColumn("_bin", right_closed_bin(F.col(prediction), edges))
    groups = binned.groupBy("_bin").agg(
        F.count("*").alias("_n"), F.avg(label).alias("_y"), F.avg(prediction).alias("_p")
    )
    total = F.sum("_n")
    return groups.agg((F.sum(F.col("_n") * F.abs(F.col("_y") - F.col("_p"))) / total).alias("ece"))


def calibration_line(df: DataFrame, label: str, prediction: str, steps: int = 25) -> tuple[float, float]:
    """Intercept and slope of the logistic regression of the label on the predicted logit.

    Newton steps on two parameters; each reads five sums from all rows.
    """
    p = _probability(F.col(prediction))
    rows = df.select(F.col(label).cast("double").alias("y"), F.log(p / (1 - p)).alias("x")).persist()
    a, b = 0.0, 1.0
    try:
        for _ in range(steps):
            fitted = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
            w = fitted * (1 - fitted)
            r = F.col("y") - fitted
            s = rows.agg(
                F.sum(r).alias("g0"),
                F.sum(r * F.col("x")).alias("g1"),
                F.sum(w).alias("h00"),
                F.sum(w * F.col("x")).alias("h01"),
                F.sum(w * F.col("x") * F.col("x")).alias("h11"),
            ).first()
            det = s["h00"] * s["h11"] - s["h01"] ** 2
            if not det or not math.isfinite(det):
                return float("nan"), float("nan")
            da = (s["h11"] * s["g0"] - s["h01"] * s["g1"]) / det
            db = (s["h00"] * s["g1"] - s["h01"] * s["g0"]) / det
            a, b = a + da, b + db
            if abs(da) + abs(db) < 1e-10:
                break
    finally:
        rows.unpersist()
    return a, b


def transport(train: DataFrame, test: DataFrame, label: str, prediction: str) -> DataFrame:
    """Out-of-time figures of one outcome model: drift, skill, loss, discrimination (one row)."""
    y = F.coalesce(safe_double(label), F.lit(0.0))
    base = train.agg(F.count("*").alias("train_n"), F.avg(y).alias("train_rate"))
    scored = test.select(y.alias("y"), _probability(F.col(prediction)).alias("p")).crossJoin(F.broadcast(base))
    null = _probability(F.col("train_rate"))
    loss = lambda p: -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    square = lambda p: (F.col("y") - p) * (F.col("y") - p)
    row = scored.groupBy("train_n", "train_rate").agg(
        F.count("*").alias("test_n"),
        F.avg("y").alias("test_rate"),
        F.avg("p").alias("mean_prediction"),
        F.avg(square(F.col("p"))).alias("brier"),
        F.avg(square(null)).alias("brier_null"),
        F.avg(loss(F.col("p"))).alias("log_loss"),
        F.avg(loss(null)).alias("log_loss_null"),
    )
    row = row.withColumns(
        {
            "prevalence_drift": F.abs(F.col("test_rate") - F.col("train_rate")),
            "prevalence_ratio": F.try_divide(F.col("test_rate"), F.col("train_rate")),
            "brier_skill": 1 - F.try_divide(F.col("brier"), F.col("brier_null")),
            "beats_null": F.col("brier") < F.col("brier_null"),
        }
    )
    ece = expected_calibration_error(scored, "y", "p")
    return row.crossJoin(F.broadcast(auc(scored, "y", "p"))).crossJoin(F.broadcast(ece))


def transport_with_calibration(train: DataFrame, test: DataFrame, label: str, prediction: str) -> DataFrame:
    y = F.coalesce(safe_double(label), F.lit(0.0))
    a, b = calibration_line(test.select(y.alias("y"), F.col(prediction).alias("p")), "y", "p")
    acceptable = F.lit(math.isfinite(b) and 0.8 <= b <= 1.2)
    return transport(train, test, label, prediction).withColumns(
        {"calibration_intercept": F.lit(a), "calibration_slope": F.lit(b), "slope_acceptable": acceptable}
    )


def measurement_diagnostics(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Zero share and positive spread per construct; ``pairs`` maps raw to calibrated column."""
    lines = [
        F.struct(F.lit(r).alias("component"), safe_double(r).alias("raw"), safe_double(c).alias("cal"))
        for r, c in pairs.items()
    ]
    long = df.select(F.inline(F.array(*lines))).filter("raw IS NOT NULL AND cal IS NOT NULL")
    positive = F.col("raw") > 0
    basic = long.groupBy("component").agg(
        F.count("*").alias("observed_items"),
        F.count_if(F.col("raw") == 0).alias("zero_items"),
        F.avg((F.col("raw") == 0).cast("double")).alias("zero_share"),
        F.count_if(positive).alias("positive_items"),
    )
    values = long.filter(positive).select("component", "raw").distinct().groupBy("component")
    unique = values.agg(F.count("*").alias("positive_unique_values"))
    q = exact_quantiles(long.filter(positive), ["raw", "cal"], [0.25, 0.75, 0.01, 0.99], ["component"])
    iqr, width = F.col("p1") - F.col("p0"), F.col("p3") - F.col("p2")
    spread = q.groupBy("component").agg(
        *[
            F.max(F.when(F.col("name") == n, e)).alias(f"positive_{label}")
            for n, tag in (("raw", "raw"), ("cal", "calibrated"))
            for label, e in ((f"{tag}_iqr", iqr), (f"{tag}_width", width))
        ]
    )
    joined = basic.join(unique, "component", "left").join(spread, "component", "left")
    ok = (
        (F.col("observed_items") >= E.MIN_N)
        & (F.coalesce("positive_unique_values", F.lit(0)) >= E.MIN_BINS)
        & (F.coalesce("positive_calibrated_iqr", F.lit(0.0)) > 0)
    )
    return joined.withColumn("support_flag", F.when(ok, "PASS").otherwise("REVIEW"))


def _residual_lines(df: DataFrame, treatments: Sequence[str]) -> DataFrame:
    lines = [
        F.struct(
            F.lit(t).alias("treatment"),
            safe_double(f"raw_{t}").alias("raw"),
            safe_double(f"mhat_{t}").alias("mhat"),
            safe_double(f"res_{t}").alias("res"),
        )
        for t in treatments
    ]
    long = df.select(F.inline(F.array(*lines)))
    return long.filter("raw IS NOT NULL AND mhat IS NOT NULL AND res IS NOT NULL")


def residual_diagnostics(df: DataFrame, treatments: Sequence[str], **limits) -> DataFrame:
    """Zero share, spread and gate decision of each treatment's residual."""
    observed = _residual_lines(df, treatments)
    basic = observed.groupBy("treatment").agg(
        F.count("*").alias("observed_n"),
        F.avg((F.col("raw") == 0).cast("double")).alias("raw_zero_share"),
        F.coalesce(F.stddev("mhat"), F.lit(0.0)).alias("mhat_sd"),
        F.avg("res").alias("residual_mean"),
    )
    both = df.withColumns(
        {
            t: F.when(
                safe_double(f"raw_{t}").isNotNull() & safe_double(f"mhat_{t}").isNotNull(), safe_double(f"res_{t}")
            )
            for t in treatments
        }
    )
    gate = E.support(both, treatments, **limits).drop("support_n")
    status = F.when(F.col("estimable"), "PASS").otherwise("REVIEW")
    return gate.join(basic, "treatment", "left").withColumn("status", status).drop("estimable")


def stratified_overlap(df: DataFrame, treatments: Sequence[str], bins: int = 10) -> DataFrame:
    """Residual spread within equal-frequency strata of the predicted treatment."""
    edges = quantile_edges(_prediction_frame(df, treatments), treatments, bins)
    long = _residual_lines(df, treatments)
    stratum = F.lit(None).cast("int")
    for t in treatments:
        stratum = F.when(F.col("treatment") == t, right_closed_bin(F.col("mhat"), edges.get(t, []))).otherwise(stratum)
    binned = long.withColumn("stratum", stratum + 1)
    keys = ["treatment", "stratum"]
    basic = binned.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("mhat").alias("mhat_min"),
        F.max("mhat").alias("mhat_max"),
        F.avg((F.col("raw") == 0).cast("double")).alias("raw_zero_share"),
        F.avg("res").alias("residual_mean"),
        F.stddev("res").alias("residual_sd"),
    )
    q = exact_quantiles(binned, ["raw", "res"], [0.25, 0.75, 0.01, 0.99], keys)
    spread = q.groupBy(*keys).agg(
        F.max(F.when(F.col("name") == "raw", F.col("p2"))).alias("raw_p01"),
        F.max(F.when(F.col("name") == "raw", F.col("p3"))).alias("raw_p99"),
        F.max(F.when(F.col("name") == "res", F.col("p1") - F.col("p0"))).alias("residual_iqr"),
        F.max(F.when(F.col("name") == "res", F.col("p3") - F.col("p2"))).alias("residual_width"),
    )
    ok = (F.col("n") >= STRATUM_MIN_N) & (F.coalesce("residual_iqr", F.lit(0.0)) >= STRATUM_MIN_IQR)
    return basic.join(spread, keys).withColumn("status", F.when(ok, "PASS").otherwise("REVIEW"))


def _prediction_frame(df: DataFrame, treatments: Sequence[str]) -> DataFrame:
    known = {
        t: F.when(safe_double(f"raw_{t}").isNotNull() & safe_double(f"res_{t}").isNotNull(), safe_double(f"mhat_{t}"))
        for t in treatments
    }
    return df.select(*[c.alias(t) for t, c in known.items()])


def overlap_summary(strata: DataFrame) -> DataFrame:
    """Per treatment: strata, smallest stratum and share with enough variation."""
    passed = F.col("status") == "PASS"
    return strata.groupBy("treatment").agg(
        F.count("*").alias("strata"),
        F.min("n").alias("minimum_stratum_n"),
        F.min("residual_iqr").alias("minimum_stratum_iqr"),
        F.median("residual_iqr").alias("median_stratum_iqr"),
        F.count_if(passed).alias("supported_strata"),
        F.avg(passed.cast("double")).alias("supported_share"),
        F.bool_and(passed).alias("all_strata_pass"),
    )


RANK_SCHEMA = (
    "specification string, included int, complete_n long, matrix_rank int, min_covariance_eigenvalue double, "
    "covariance_condition double, min_correlation_eigenvalue double, max_correlation_eigenvalue double, "
    "correlation_condition double, status string"
)


def _condition(values: np.ndarray) -> float:
    low, high = float(values.min()), float(values.max())
    return high / low if low > 0 else float("inf")


def _rank_row(name: str, columns: Sequence[str], cross: Cross) -> tuple:
    if cross.n < 2 or len(columns) < 2:
        return (name, len(columns), int(cross.n), 0, *[float("nan")] * 5, "NOT_ESTIMABLE")
    corr = correlation(cross, columns)
    s = cross.block(["const"], columns)[0]
    cov = (cross.block(columns, columns) - np.outer(s, s) / cross.n) / (cross.n - 1)
    cov_values, values = np.linalg.eigvalsh(cov), np.linalg.eigvalsh(np.nan_to_num(corr))
    rank = int(np.linalg.matrix_rank(np.nan_to_num(corr), tol=1e-10))
    ok = rank == len(columns) and cov_values.min() > 0 and values.min() > 1e-8
    return (
        name, len(columns), int(cross.n), rank, float(cov_values.min()), _condition(cov_values),
        float(values.min()), float(values.max()), _condition(values), "PASS" if ok else "REVIEW",
    )


def rank_diagnostics(df: DataFrame, specifications: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rank and conditioning of several column sets from one scan."""
    clean = E.numeric_columns(df, [c for cs in specifications.values() for c in cs])
    found = moments(clean, [Problem(n, tuple(cs)) for n, cs in specifications.items()])
    rows = [_rank_row(n, list(cs), found[(ALL, n)]) for n, cs in specifications.items()]
    return E.small_frame(df.sparkSession, rows, RANK_SCHEMA)


def correlation_block(df: DataFrame, controls: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Correlation of each control with each target over the pair's complete rows."""
    pairs = [(a, b) for a in controls for b in targets]
    clean = E.numeric_columns(df, [*controls, *targets])
    row = clean.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    lines = [
        F.struct(F.lit(a).alias("control"), F.lit(b).alias("target"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*lines)))


def selected_contrasts(tests: DataFrame, omnibus_p: str = "p_holm") -> DataFrame:
    """Highest-against-reference contrast of every cue whose omnibus test is significant.

    ``tests`` is a moderation table with a Holm column per test kind.
    """
    keys = ["stage", "treatment"]
    joint = tests.filter((F.col("test") == "omnibus") & (F.col(omnibus_p) < 0.05)).select(*keys)
    single = tests.filter(F.col("test") != "omnibus")
    level = F.regexp_extract("test", r"^H(\d+)-", 1).try_cast("int")
    best = single.withColumn("_l", level).groupBy(*keys).agg(F.max_by(F.struct(*single.columns), "_l").alias("_r"))
    return best.join(joint, keys, "left_semi").select("_r.*")


def evidence_rows(parts: Sequence[tuple[str, DataFrame, str, str, str]]) -> DataFrame:
    """One row per analysis: (name, one-row frame, condition, label if met, label if not)."""
    out = None
    for name, frame, condition, met, unmet in parts:
        row = frame.select(
            F.lit(name).alias("analysis"),
            F.when(F.expr(condition), met).otherwise(unmet).alias("assessment"),
            F.to_json(F.struct("*")).alias("result"),
        )
        out = row if out is None else out.unionByName(row)
    return out


# fixed values: status of each assessment
STATUS = {
    "SUPPORTS_TEMPORAL_TRANSPORT": "PASS",
    "CALIBRATION_LIMITATION": "SCOPE_LIMIT",
    "LIMITS_EXTERNAL_VALIDITY": "SCOPE_LIMIT",
    "STABLE": "PASS",
    "FOCAL_RESULTS_STABLE_WITH_LOCAL_EXCEPTIONS": "PASS_WITH_LOCAL_EXCEPTIONS",
    "SIGNIFICANT_EFFECT_DIRECTIONS_STABLE": "PASS",
    "FOCAL_EFFECTS_DIFFER_FROM_PERMUTATION_NULL": "PASS",
    "MIXED_PLACEBO_EVIDENCE": "PASS",
    "MODERATE_OMITTED_CONFOUNDING_SENSITIVITY": "SENSITIVITY_LIMIT",
    "HETEROGENEOUS_OMITTED_CONFOUNDING_SENSITIVITY": "SENSITIVITY_LIMIT",
    "FOCAL_SOCIAL_PROOF_LESS_SENSITIVE": "SENSITIVITY_LIMIT",
    "PREDICTIVE_RANKING_STABILITY_QUANTIFIED": "PREDICTIVE_ONLY",
}


def status_matrix(evidence: DataFrame, by: Sequence[str] = ("analysis",), column: str = "dataset") -> DataFrame:
    """Analyses as rows, datasets as columns, status as values."""
    status = F.lit("UNKNOWN")
    for assessment, value in STATUS.items():
        status = F.when(F.col("assessment") == assessment, value).otherwise(status)
    return evidence.withColumn("status", status).groupBy(*by).pivot(column).agg(F.first("status"))
