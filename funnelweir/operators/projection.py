"""Pathway orthogonalisation: remove the linear image of one residual set from another."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.functions.scalars import safe_double
from funnelweir.operators.moments import ALL, CONST, Problem, linear, moments, solve


def projection_design(df: DataFrame, controls: Sequence[str], mode: str = "linear") -> tuple[DataFrame, list[str]]:
    """Zero-filled controls, with squares and pairwise products in ``linear_quadratic`` mode."""
    names, exprs = [], {}
    filled = {c: safe_double(c, 0.0) for c in controls}
    for c in controls:
        names.append(f"_d_{c}")
        exprs[f"_d_{c}"] = filled[c]
    if mode == "linear_quadratic":
        for c in controls:
            names.append(f"_d_{c}__sq")
            exprs[f"_d_{c}__sq"] = filled[c] * filled[c]
        for i, left in enumerate(controls):
            for right in controls[i + 1 :]:
                names.append(f"_d_{left}__x__{right}")
                exprs[f"_d_{left}__x__{right}"] = filled[left] * filled[right]
    elif mode != "linear":
        raise ValueError(mode)
    return df.withColumns(exprs), names


def fit_projection(
    train: DataFrame, controls: Sequence[str], targets: Sequence[str], mode: str = "linear", fill_controls: bool = True
) -> dict[str, dict]:
    """Least squares of every target on the controls; one scan for all targets.

    A target needs more observed rows than design columns plus five, else its
    entry has no parameters. ``fill_controls=False`` drops rows with a missing
    control instead of reading it as zero.
    """
    clean = train.withColumns({t: safe_double(t) for t in targets})
    if not fill_controls:
        clean = clean.dropna(subset=list(controls))
    wide, design = projection_design(clean, controls, mode)
    problems = [Problem(t, tuple(design), (t,), fill_x=True) for t in targets]
    found = moments(wide, problems)
    fitted = {}
    for t in targets:
        cross = found[(ALL, t)]
        columns = [CONST, *design]
        if cross.n <= len(columns) + 5:
            fitted[t] = {"train_n": cross.n, "parameters": None, "r2": None, "design": columns}
            continue
        fit = solve(cross, columns, t)
        fitted[t] = {
            "train_n": cross.n,
            "r2": fit.r2,
            "design": columns,
            "parameters": dict(zip(columns, map(float, fit.beta))),
        }
    return fitted


def apply_projection(
    final: DataFrame,
    controls: Sequence[str],
    fitted: dict[str, dict],
    mode: str = "linear",
    suffix: str = "__gs_pure",
) -> tuple[DataFrame, list[str]]:
    """Add ``<target><suffix>`` = target minus its fitted projection; frozen parameters may come from a file."""
    wide, design = projection_design(final, controls, mode)
    pure = {}
    for target, about in fitted.items():
        if about["parameters"] is None:
            pure[f"{target}{suffix}"] = F.lit(None).cast("double")
            continue
        columns = about["design"]
        beta = [about["parameters"][c] for c in columns]
        pure[f"{target}{suffix}"] = safe_double(target) - linear(columns, beta)
    return wide.withColumns(pure).drop(*design), list(pure)


def fit_apply(
    train: DataFrame,
    final: DataFrame,
    controls: Sequence[str],
    targets: Sequence[str],
    mode: str = "linear",
    suffix: str = "__gs_pure",
) -> tuple[DataFrame, list[str], DataFrame, dict[str, dict]]:
    """Fit on one split, apply to the next: (frame, treatment columns, diagnostics, parameters)."""
    fitted = fit_projection(train, controls, targets, mode)
    out, pure = apply_projection(final, controls, fitted, mode, suffix)
    status = {True: "fitted_on_A_to_B_residuals", False: "insufficient_training_support"}
    report = pd.DataFrame(
        [
            (t, int(a["train_n"]), a["r2"], status[a["parameters"] is not None])
            for t, a in fitted.items()
        ],
        columns=["target", "train_n", "projection_r2", "status"],
    )
    schema = "target string, train_n long, projection_r2 double, status string"
    diagnostics = final.sparkSession.createDataFrame(report, schema)
    return out, [*controls, *pure], diagnostics, fitted


def reverse_fit_apply(train: DataFrame, final: DataFrame, controls, targets, mode: str = "linear"):
    """Roles swapped: controls are purified by the targets, which stay as they are."""
    out, columns, diagnostics, fitted = fit_apply(train, final, targets, controls, mode, "__reverse_gs_pure")
    pure = [c for c in columns if c.endswith("__reverse_gs_pure")]
    return out, [*pure, *targets], diagnostics, fitted
