"""Cross-product sums, least squares on them, and clustered covariances.

Each task reduces its Arrow batches to one small matrix per problem and level,
so a regression of any size ships only d x d numbers; solves run on the driver
on matrices of at most a few dozen columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelweir.functions.clusters import Influence, outer_sums, sorted_cluster_sums

ALL = "ALL"
CONST = "const"
# influence columns of one scan for robust errors
SCORE_CHUNK = 60


@dataclass(frozen=True)
class Problem:
    """One regression sample: rows with every ``y`` (and, unless ``fill_x``, every ``x``) present."""

    name: str
    x: tuple[str, ...]
    y: tuple[str, ...] = ()
    weight: str | None = None
    fill_x: bool = False
    intercept: bool = True

    @property
    def design(self) -> list[str]:
        return ([CONST] if self.intercept else []) + list(self.x)

    @property
    def columns(self) -> list[str]:
        return [*self.design, *self.y]


@dataclass
class Cross:
    """Z'WZ over ``names`` with the number of rows."""

    names: list[str]
    n: int
    matrix: np.ndarray

    def block(self, rows: Sequence[str], cols: Sequence[str]) -> np.ndarray:
        index = {c: i for i, c in enumerate(self.names)}
        return self.matrix[np.ix_([index[r] for r in rows], [index[c] for c in cols])]

    def __add__(self, other: Cross) -> Cross:
        return Cross(self.names, self.n + other.n, self.matrix + other.matrix)


def moments(
    df: DataFrame, problems: Sequence[Problem], by: str | None = None
) -> dict[tuple[str, str], Cross]:
    """Cross products of every problem in one scan, keyed by (level, problem name).

    ``by`` is a low-cardinality level column; level ``ALL`` is the total.
    """
    numeric = list(dict.fromkeys(c for p in problems for c in (*p.x, *p.y, *([p.weight] if p.weight else []))))
    position = {c: i for i, c in enumerate(numeric)}
    layout = [
        (
            [position[c] for c in p.x],
            [position[c] for c in p.y],
            position[p.weight] if p.weight else None,
            p.fill_x,
            p.intercept,
        )
        for p in problems
    ]
    level = F.col(by).cast("string") if by else F.lit(ALL)
    source = df.select(level.alias("_level"), *[F.col(c).cast("double").alias(c) for c in numeric])

    def reduce_batches(batches):
        totals: dict = {}
        for batch in batches:
            values = batch[numeric].to_numpy(dtype=float)
            finite = np.isfinite(values)
            filled = np.where(finite, values, 0.0)
            codes, names = pd.factorize(batch["_level"], use_na_sentinel=False)
            for code, name in enumerate(names):
                here = codes == code
                for number, (x, y, w, fill, constant) in enumerate(layout):
                    needed = y + ([w] if w is not None else []) + ([] if fill else x)
                    rows = here & finite[:, needed].all(axis=1) if needed else here
                    z = filled[rows][:, x + y]
                    if constant:
                        z = np.column_stack([np.ones(len(z)), z])
                    weighted = z * filled[rows, w][:, None] if w is not None else z
                    n, matrix = totals.get((name, number), (0, 0.0))
                    totals[(name, number)] = (n + len(z), matrix + weighted.T @ z)
        yield pd.DataFrame(
            [(k[0], k[1], n, m.ravel().tolist()) for k, (n, m) in totals.items()],
            columns=["level", "problem", "n", "cells"],
        )

    partial = source.mapInPandas(reduce_batches, "level string, problem int, n long, cells array<double>")
    summed = (
        partial.select("level", "problem", "n", F.posexplode("cells").alias("cell", "value"))
        .groupBy("level", "problem", "cell")
        .agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        .collect()
    )
    found: dict[tuple[str, str], Cross] = {}
    for row in summed:
        p = problems[row["problem"]]
        d = len(p.columns)
        key = (row["level"], p.name)
        cross = found.setdefault(key, Cross(p.columns, row["n"], np.zeros((d, d))))
        cross.matrix[divmod(row["cell"], d)] = row["value"]
    if by:
        for p in problems:
            parts = [c for (lv, name), c in found.items() if name == p.name and lv != ALL]
            if parts:
                total = parts[0]
                for part in parts[1:]:
                    total = total + part
                found[(ALL, p.name)] = total
    for p in problems:
        d = len(p.columns)
        found.setdefault((ALL, p.name), Cross(p.columns, 0, np.zeros((d, d))))
    return found


@dataclass
class Fit:
    """Least squares of ``y`` on ``design`` for one problem and level.

    ``names`` are the reported combinations of coefficients (by default every
    non-constant one) and ``combine`` their weights; ``covariance`` is theirs.
    """

    name: str
    y: str
    design: list[str]
    beta: np.ndarray
    bread: np.ndarray
    n: int
    sse: float
    sst: float
    level: str = ALL
    by: str | None = None
    weight: str | None = None
    names: list[str] = field(default_factory=list)
    combine: np.ndarray | None = None
    covariance: np.ndarray | None = None
    kind: str = "none"
    clusters: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.names:
            self.report({c: {c: 1.0} for c in self.design if c != CONST})

    def report(self, combinations: dict[str, dict[str, float]]) -> Fit:
        """Choose what to estimate: name -> {design column: weight}."""
        self.names = list(combinations)
        self.combine = np.zeros((len(self.names), len(self.design)))
        for i, weights in enumerate(combinations.values()):
            for column, weight in weights.items():
                self.combine[i, self.design.index(column)] = weight
        return self

    @property
    def r2(self) -> float:
        return 1.0 - self.sse / self.sst if self.sst > 0 else float("nan")

    @property
    def values(self) -> np.ndarray:
        return self.combine @ self.beta

    def coefficient(self, name: str) -> float:
        return float(self.values[self.names.index(name)])

    def error(self, name: str) -> float:
        i = self.names.index(name)
        variance = float(self.covariance[i, i])
        return float(np.sqrt(variance)) if variance >= 0 else float("nan")


def solve(cross: Cross, design: Sequence[str], y: str, penalty: float = 0.0, **about) -> Fit:
    """Normal-equation solution on a block of ``cross``.

    ``penalty`` is a ridge weight relative to each column's own sum of squares.
    """
    design = list(design)
    xtx = cross.block(design, design)
    xty = cross.block(design, [y])[:, 0]
    yty = float(cross.block([y], [y])[0, 0])
    shrink = penalty * np.diag([0.0 if c == CONST else xtx[i, i] for i, c in enumerate(design)])
    bread = np.linalg.pinv(xtx + shrink, hermitian=True)
    beta = bread @ xty
    sse = max(0.0, yty - 2 * float(beta @ xty) + float(beta @ xtx @ beta))
    if CONST in design:
        total = cross.block([CONST], [CONST])[0, 0]
        mean = cross.block([CONST], [y])[0, 0]
        sst = yty - mean * mean / total if total else 0.0
    else:
        sst = yty
    return Fit(about.pop("name", y), y, design, beta, bread, cross.n, sse, float(sst), **about)


def linear(design: Sequence[str], beta: Sequence[float], fill: bool = False) -> Column:
    """Fitted value as a column expression."""
    total = F.lit(0.0)
    for c, b in zip(design, beta):
        if c == CONST:
            term = F.lit(float(b))
        else:
            term = (F.coalesce(F.col(c), F.lit(0.0)) if fill else F.col(c)) * F.lit(float(b))
        total = total + term
    return total


def _in_sample(fit: Fit) -> Column:
    ok = F.col(fit.y).isNotNull()
    for c in fit.design:
        if c != CONST:
            ok = ok & F.col(c).isNotNull()
    if fit.by and fit.level != ALL:
        ok = ok & F.col(fit.by).cast("string").eqNullSafe(F.lit(fit.level))
    return ok


def _influence(i: int, fit: Fit) -> list[Column]:
    """Each row's contribution to every reported combination, plus a sample flag."""
    ok = _in_sample(fit)
    residual = F.col(fit.y) - linear(fit.design, fit.beta)
    if fit.weight:
        residual = residual * F.col(fit.weight)
    out = [ok.cast("double").alias(f"_s{i}_n")]
    for j, weights in enumerate(fit.combine @ fit.bread):
        value = residual * linear(fit.design, weights)
        out.append(F.when(ok, value).otherwise(F.lit(0.0)).alias(f"_s{i}_{j}"))
    return out


def _chunks(fits: Sequence[Fit]):
    chunk: list[Fit] = []
    width = 0
    for fit in fits:
        if chunk and width + len(fit.names) + 1 > SCORE_CHUNK:
            yield chunk
            chunk, width = [], 0
        chunk.append(fit)
        width += len(fit.names) + 1
    if chunk:
        yield chunk


def _cluster_terms(
    df: DataFrame, fits: Sequence[Fit], groupings: Mapping[str, Sequence[str]], derive: Callable[[DataFrame], DataFrame] | None = None
) -> dict[tuple[str, int], tuple[np.ndarray, int]]:
    """Per grouping and fit: influence outer products summed over clusters, and the number of clusters.

    What is shuffled are the regressions' own columns, once in the order (user, item), which
    serves users and pairs, and once by item; influences exist inside the tasks only, for all
    fits at once. Rows are range-sorted down to their numbers, so a cluster of any size spans
    as many tasks as it needs; of each partition only the two clusters at its ends are merged
    outside. ``derive`` adds columns that follow from those of ``df``: it is applied to the
    sorted rows, so what it adds is neither shuffled nor sorted.
    """
    numbers = list(dict.fromkeys(c for f in fits for c in (f.y, *f.design, *([f.weight] if f.weight else [])) if c != CONST))
    levels = list(dict.fromkeys(f.by for f in fits if f.by and f.level != ALL))
    orders: dict[tuple[str, ...], dict[str, Sequence[str]]] = {}
    for label, by in sorted(groupings.items(), key=lambda g: -len(g[1])):
        order = next((o for o in orders if o[: len(by)] == tuple(by)), tuple(by))
        orders.setdefault(order, {})[label] = by
    influences = [
        Influence(f.y, tuple(f.design), f.beta, f.combine @ f.bread, f.weight, f.by if f.level != ALL else None, f.level) for f in fits
    ]
    found: dict[tuple, dict[int, float]] = {}
    keys = {k for order in orders for k in order}
    for order, served in orders.items():
        sent = numbers if derive is None else [c for c in df.columns if c not in keys]
        rows = df.select(
            *[F.col(k).cast("string").alias(k) for k in order],
            *[(F.col(c) if derive else F.col(c).cast("double")).alias(c) for c in sent if c not in order],
            *[F.col(c).cast("string").alias(f"_by_{c}") for c in levels],
        )
        placed = rows.repartitionByRange(*order, *sent).sortWithinPartitions(*order)
        if derive:
            placed = derive(placed).select(*order, *[F.col(c).cast("double").alias(c) for c in numbers if c not in order], *[f"_by_{c}" for c in levels])
        schema = f"label string, edge boolean, {''.join(f'key{i} string, ' for i in range(len(order)))}fit int, cells array<double>"
        sums = placed.mapInArrow(sorted_cluster_sums(served, numbers, influences), schema)
        by = ["label", "edge", *[f"key{i}" for i in range(len(order))], "fit"]
        cells = sums.select(*by, F.posexplode("cells").alias("cell", "value")).groupBy(*by, "cell").agg(F.sum("value").alias("value"))
        for r in cells.collect():
            found.setdefault(tuple(r[k] for k in by), {})[r["cell"]] = r["value"]
    edges = np.cumsum([0, *[len(f.names) + 1 for f in fits]])
    totals = {(g, i): np.zeros((b - a, b - a)) for g in groupings for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))}
    for (label, edge, *_, i), cells in found.items():
        values = np.array([cells[c] for c in range(len(cells))])
        if not edge:
            totals[label, i] += values.reshape(totals[label, i].shape)
            continue
        for j, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            totals[label, j] += outer_sums(values[None, a:b])
    return {k: (m[1:, 1:], int(round(m[0, 0]))) for k, m in totals.items()}


def cluster_errors(
    df: DataFrame, fits: Sequence[Fit], user: str, item: str | None, derive: Callable[[DataFrame], DataFrame] | None = None
) -> Sequence[Fit]:
    """Fill clustered covariances: user + item - pair, each with its small-sample factor.

    Influences are linear in the scores, so only the reported combinations are
    summed per cluster. With ``derive``, ``df`` holds no more than what the regressions'
    columns follow from, and ``derive(df)`` has them.
    """
    groupings = {"user": [user]}
    if item:
        groupings.update(item=[item], pair=[user, item])
    terms = _cluster_terms(df, fits, groupings, derive) if fits else {}
    for i, fit in enumerate(fits):
        k, m = len(fit.design), len(fit.names)

        def corrected(label):
            matrix, groups = terms[(label, i)]
            if groups < 2 or fit.n <= k:
                return np.full((m, m), np.nan)
            return groups / (groups - 1.0) * (fit.n - 1.0) / (fit.n - k) * matrix

        fit.clusters = {label: terms[(label, i)][1] for label in groupings}
        if item:
            total = corrected("user") + corrected("item") - corrected("pair")
        if item and np.isfinite(total).all():
            fit.covariance, fit.kind = total, "two_way_cluster_user_item"
        else:
            fit.covariance, fit.kind = corrected("user"), "cluster_user"
    return fits


def robust_errors(df: DataFrame, fits: Sequence[Fit]) -> Sequence[Fit]:
    """Heteroskedasticity-consistent (HC1) covariances from one scan per chunk."""
    for part in _chunks(fits):
        scored = df.select(*[c for i, fit in enumerate(part) for c in _influence(i, fit)])
        problems = [
            Problem(str(i), tuple(f"_s{i}_{j}" for j in range(len(fit.names))), intercept=False)
            for i, fit in enumerate(part)
        ]
        found = moments(scored, problems)
        for i, fit in enumerate(part):
            fit.covariance = fit.n / max(1.0, fit.n - len(fit.design)) * found[(ALL, str(i))].matrix
            fit.kind = "hc1"
    return fits


def correlation(cross: Cross, columns: Sequence[str]) -> np.ndarray:
    """Correlation matrix from a cross with intercept."""
    n = cross.block([CONST], [CONST])[0, 0]
    s = cross.block([CONST], columns)[0]
    cov = cross.block(columns, columns) - np.outer(s, s) / n
    scale = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        return cov / np.outer(scale, scale)
