"""Histogram boosting: against a plain leaf-wise learner, models apart and together, odd inputs, a known effect."""

import numpy as np
import pandas as pd
import pytest

from funnelweir.operators import boosting as BO
from funnelweir.operators import effects as E
from funnelweir.operators import nuisance as N

SMALL = BO.Settings(trees=4, rate=0.3, depth=4, leaves=7, row_share=1.0, column_share=1.0, bins=32, min_rows=15)


def plain_boosting(x, y, s, classify=False, edges=None):
    """Best-first trees on the values themselves, cuts between the store's bins."""
    edges = edges or [np.unique(np.quantile(c, np.arange(1, s.bins) / s.bins, method="inverted_cdf")) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    p = y.mean()
    score = np.full(len(y), np.log(p / (1 - p)) if classify else p)

    def split(rows, g, h):
        best = None
        for f in range(x.shape[1]):
            for cut in range(len(edges[f])):
                left = bins[rows, f] <= cut
                a, b = rows[left], rows[~left]
                if min(len(a), len(b)) < s.min_rows:
                    continue
                gain = sum(g[r].sum() ** 2 / h[r].sum() for r in (a, b)) - g[rows].sum() ** 2 / h[rows].sum()
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, a, b)
        return best

    for _ in range(s.trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = (prob - y, prob * (1 - prob)) if classify else (score - y, np.ones(len(y)))
        leaves = [(np.arange(len(y)), 0, split(np.arange(len(y)), g, h))]
        while len(leaves) < s.leaves:
            at = max((i for i, leaf in enumerate(leaves) if leaf[2] and leaf[1] < s.depth), key=lambda i: leaves[i][2][0], default=None)
            if at is None:
                break
            _, depth, (_, a, b) = leaves.pop(at)
            leaves += [(r, depth + 1, split(r, g, h)) for r in (a, b)]
        for rows, _, _ in leaves:
            score[rows] -= s.rate * g[rows].sum() / h[rows].sum()
    return 1 / (1 + np.exp(-score)) if classify else score


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    n = 700
    pdf = pd.DataFrame({"k": range(n), "a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": rng.random(n)})
    signal = np.sin(2 * pdf.a) + (pdf.b > 2) * pdf.c
    pdf["y"] = signal + 0.2 * rng.normal(size=n)
    pdf["z"] = (rng.random(n) < 1 / (1 + np.exp(-3 * signal))).astype(float)
    pdf["even"] = pdf.k % 2 == 0
    return pdf


X = ("a", "b", "c")


@pytest.mark.parametrize("target,classify", [("y", False), ("z", True)])
def test_equals_a_plain_leaf_wise_learner(spark, data, target, classify):
    df = spark.createDataFrame(data).repartition(3)
    model = BO.fit(df, [BO.Task(target, X, classify)], SMALL)[0]
    got = BO.predict(df, {"p": model}).toPandas().sort_values("k").p.to_numpy()
    assert np.allclose(got, plain_boosting(data[list(X)].to_numpy(), data[target].to_numpy(), SMALL, classify, model.edges), atol=1e-9)
    assert max(sum(f < 0 for f in t.feature) for t in model.trees) <= SMALL.leaves


def test_models_together_equal_models_apart(spark, data):
    """Shared passes change nothing: row groups, feature sets and missing targets stay apart."""
    gaps = data.assign(y=data.y.where(data.k % 3 > 0))
    df = spark.createDataFrame(gaps).selectExpr("*", "nullif(y, double('NaN')) AS yy").repartition(5)
    tasks = [BO.Task("yy", X, False, "even"), BO.Task("z", X[:2], True), BO.Task("yy", X[1:], False)]
    together = BO.fit(df, tasks, SMALL)
    frames = [df.filter("even AND yy IS NOT NULL"), df, df.filter("yy IS NOT NULL")]
    scored = BO.predict(df, dict(zip("pqr", together, strict=True))).toPandas().sort_values("k")
    for name, task, own in zip("pqr", tasks, frames, strict=True):
        rows, edges = own.toPandas(), together[0].edges
        columns = [X.index(f) for f in task.features]
        assert [together["pqr".index(name)].columns, edges] == [columns, edges]
        x = rows[list(task.features)].to_numpy()
        # the same edges, as groups share the store's
        bins = np.stack([np.searchsorted(edges[i], x[:, j], "left") for j, i in enumerate(columns)], axis=1).astype(float)
        expected = plain_boosting(bins, rows[task.target].to_numpy(), BO.Settings(**{**SMALL.__dict__, "bins": 256}), task.classify)
        assert np.allclose(scored.set_index("k")[name][rows.k].to_numpy(), expected, atol=1e-9)


def test_draws_and_full_settings_learn_held_out_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6000, 4))
    truth = np.sin(2 * x[:, 0]) + (x[:, 1] > 0) * x[:, 2]
    pdf = pd.DataFrame({**{f"x{i}": x[:, i] for i in range(4)}, "y": truth + 0.3 * rng.standard_normal(6000), "f": truth})
    train, test = spark.createDataFrame(pdf[:4000]), spark.createDataFrame(pdf[4000:])
    models = BO.fit(train, [BO.Task("y", ("x0", "x1", "x2", "x3"))], BO.Settings(trees=60, rate=0.15))
    again = BO.fit(train, [BO.Task("y", ("x0", "x1", "x2", "x3"))], BO.Settings(trees=60, rate=0.15))
    assert [t.__dict__ for t in models[0].trees] == [t.__dict__ for t in again[0].trees]
    out = BO.predict(test, {"p": models[0]}).toPandas()
    assert ((out.p - out.f) ** 2).mean() < 0.08 * out.f.var()


def test_constants_gaps_and_empty_tables(spark):
    df = spark.createDataFrame([(float(i % 3), 5.0, None, None if i % 2 else 1.0) for i in range(60)], "x double, one double, gone double, half double")
    tasks = [BO.Task(t, ("x",)) for t in ("one", "gone", "half", "x")] + [BO.Task("half", ("x",), True)]
    models = BO.fit(df, tasks, SMALL)
    row = BO.predict(df, {f"p{i}": m for i, m in enumerate(models)}).first()
    assert row.p0 == 5.0 and row.p1 is None and row.p2 == 1.0 and abs(row.p3 - row.x) < 0.5 and abs(row.p4 - 1) < 1e-9
    empty = df.filter("1 = 0")
    assert BO.fit(empty, tasks, SMALL) == [None] * 5
    assert BO.predict(empty, {f"p{i}": m for i, m in enumerate(models)}).count() == 0


def test_known_effect_is_recovered_after_nonlinear_nuisances(spark):
    """0.7 within 0.08: both nuisances are bent, so a linear fit leaves confounding."""
    rng = np.random.default_rng(12)
    n = 9000
    x = rng.uniform(-2, 2, size=(n, 3))
    bend = np.cos(2 * x[:, 0]) + (x[:, 1] > 0) * 1.0
    t = 0.5 + 0.12 * bend + 0.1 * rng.normal(size=n)
    y = 0.7 * t + 0.5 * bend + 0.3 * rng.normal(size=n)
    pdf = pd.DataFrame({**{f"x{i}": x[:, i] for i in range(3)}, "T_int_fac": t, "y": y, "user_id": (np.arange(n) % 300).astype(str), "item_id": (np.arange(n) % 211).astype(str)})
    train, test = spark.createDataFrame(pdf[: n // 2]), spark.createDataFrame(pdf[n // 2 :])
    settings, found = {"trees": 80, "rate": 0.1}, {}
    columns = ["x0", "x1", "x2"]
    for learner in ("ridge", "boosted"):
        out = N.residualize(train, test, ["T_int_fac", "y"], columns, "treatment", learner, settings if learner == "boosted" else None, clip=False)
        table = E.family(out.withColumnRenamed("res_y", "res_y_click"), ["res_y_click"], ["res_T_int_fac"])
        found[learner] = table.first().coefficient
    assert abs(found["boosted"] - 0.7) < 0.08 < abs(found["ridge"] - 0.7)


def test_cross_fit_shares_passes(spark, data):
    a, b = (spark.createDataFrame(data[data.k % 2 == r]) for r in (0, 1))
    models = N.boosted_cross_fit({"a": a, "b": b}, [("a", "treatment", ["y"]), ("b", "treatment", ["y"]), ("b", "outcome", ["z"])], X, SMALL.__dict__)
    out = N.boosted_residuals(N.cleaned(b, ["y"], "treatment"), ["y"], "treatment", {"y": models["a", "y"]}, clip=False).toPandas()
    assert set(models) == {("a", "y"), ("b", "y"), ("b", "z")}
    assert out.res_y.var() < 0.6 * out.raw_y.var() and np.allclose(out.raw_y - out.mhat_y, out.res_y)


def test_blocks_hold_shared_arrays_once_and_walk_by_lines():
    rng = np.random.default_rng(4)
    n, features = 500, ["a", "b", "c"]
    tasks = [BO.Task("y", ("a", "b")), BO.Task("y", ("c",)), BO.Task("y", ("a",), True, "g"), BO.Task("z", ("b",))]
    bins, y, member = rng.integers(0, 9, (n, 3)).astype(np.uint8), rng.integers(0, 2, (n, 2)).astype(float), rng.random((n, 1)) < 0.5
    y[:, 1] += 0.25
    y[:9, 0] = np.nan
    row = {"rows": n, "seed": 1, "bins": bins.tobytes(), "y": y.tobytes(), "member": member.tobytes()}
    block = BO.opened(row, tasks, features, ["y", "z"], ["g"], [0.0] * 4)
    assert block.of == [(0, 0), (0, 0), (0, 1), (1, 2)] and len(block.used) == 3
    assert block.y[0].dtype == np.uint8 and block.y[1].dtype == float and np.array_equal(block.y[1], y[:, 1])
    assert np.array_equal(block.used[1], ~np.isnan(y[:, 0]) & member[:, 0])
    tree = BO.Tree([0, -1, 2, -1, -1], [3, 0, 5, 0, 0], [1, 0, 3, 0, 0], [0.0] * 5)
    for levels in (0, 1, 2, 5):
        node = np.where(bins[:, 0] > 3, np.where((levels > 1), 3 + (bins[:, 2] > 5), 2), 1) if levels else np.zeros(n)
        assert np.array_equal(tree.walk(block.bins, levels), node)


def test_small_blocks_join_and_hold_nothing_for_models_without_rows():
    """Arrow's batches become one block; its sums and draws are those of the batches apart."""
    rng = np.random.default_rng(5)
    tasks = [BO.Task("y", ("a", "b"), False, "g"), BO.Task("y", ("a", "b"), True, "h")]

    def opened(seed, n, member):
        bins, y = rng.integers(0, 7, (n, 2)).astype(np.uint8), rng.integers(0, 2, (n, 1)).astype(float)
        groups = np.tile(np.array([member == "g", member == "h"]), (n, 1))
        return BO.opened({"rows": n, "seed": seed, "bins": bins.tobytes(), "y": y.tobytes(), "member": groups.tobytes()}, tasks, ["a", "b"], ["y"], ["g", "h"], [0.25, 0.5])

    small = [opened(1, 300, "g"), opened(1 << 40, 41, "g"), opened(7, 90, "h"), opened(8, 100, "h"), opened(9, 500, "h")]
    whole = list(BO.joined(iter(small), 341))
    assert [[rows for _, rows in b.seeds] for b in whole] == [[300, 41], [90, 100], [500]]
    assert [[v is None for v in b.scores] for b in whole] == [[False, True], [True, False], [True, False]]
    tree = BO.Tree([0, -1, -1], [3, 0, 0], [1, 0, 0], [0.0, 0.1, 0.2])
    asked = {j: (tree, np.array([0, 1]), np.array([1, 2])) for j in range(2)}
    sums = []
    for blocks in (small, whole):
        sums.append({})
        for b in blocks:
            BO.counts(BO.redrawn(BO.advanced(b, {0: tree, 1: tree}, 2), 3, 0.5, 11), asked, [False, True], np.array([7, 7]), 1, sums[-1])
    assert sums[0][0].shape == (2, 2, 14) and sums[0][1].shape == (3, 2, 14)
    assert all(np.allclose(sums[0][j], sums[1][j]) and 0 < sums[0][j][1].sum() for j in range(2))
