"""Clustered errors by sorted rows: clusters across batches, partitions and tasks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from funnelweir.functions.clusters import Influence, outer_sums, sorted_cluster_sums
from funnelweir.operators import moments as MO

FITS = [Influence("y", ("const", "x"), np.array([0.1, 0.5]), np.array([[0.2, 1.0]])), Influence("x", ("const",), np.array([0.3]), np.array([[1.0], [2.0]]))]
GROUPS = {"pair": ["u", "i"], "user": ["u"]}


def table(n=500, seed=5):
    rng = np.random.default_rng(seed)
    u = np.sort(rng.integers(0, 9, n)) // 3 * 4
    i = rng.integers(0, 4, n)
    order = np.lexsort((i, u))
    users = [None if k == 0 else str(k) for k in u[order]]
    y = rng.normal(size=n)
    y[::17] = np.nan
    return pa.table({"u": pa.array(users, pa.string()), "i": pa.array(i[order].astype(str)), "y": pa.array(y, from_pandas=True), "x": rng.normal(size=n)})


def merged(rows, cuts, batch):
    """Sums of all partitions, the clusters at their ends merged."""
    edges, totals, ends = [0, 2, 5], {}, {}
    for a, b in zip(cuts[:-1], cuts[1:]):
        for out in sorted_cluster_sums(GROUPS, ["y", "x"], FITS)(rows.slice(a, b - a).to_batches(batch)):
            for r in out.to_pylist():
                cells = np.array(r["cells"])
                if r["edge"]:
                    key = r["label"], r["key0"], r["key1"]
                    ends[key] = ends.get(key, 0) + cells
                else:
                    d = edges[r["fit"] + 1] - edges[r["fit"]]
                    totals[r["label"], r["fit"]] = totals.get((r["label"], r["fit"]), 0) + cells.reshape(d, d)
    for (label, *_), v in ends.items():
        for f in range(2):
            totals[label, f] = totals[label, f] + outer_sums(v[None, edges[f] : edges[f + 1]])
    return totals


def test_cluster_sums_do_not_depend_on_batches_and_partitions():
    rows = table()
    whole = merged(rows, [0, 500], 500)
    u = np.array([str(v) for v in rows["u"].to_pylist()])
    for cuts, batch in (([0, 500], 7), ([0, 3, 4, 200, 201, 500], 11), ([0, 250, 250, 500], 1)):
        cut = merged(rows, cuts, batch)
        assert all(np.allclose(whole[k], cut[k]) for k in whole)
    y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
    score = np.where(np.isnan(y), 0.0, (np.nan_to_num(y) - 0.1 - 0.5 * x) * (0.2 + x))
    sums = np.array([score[u == k].sum() for k in np.unique(u)])
    assert np.isclose(whole["user", 0][1, 1], (sums**2).sum())
    assert whole["user", 0][0, 0] == len(np.unique(u))


def test_shuffled_rows_hold_the_regressions_columns_only(spark, monkeypatch):
    """Many outcomes on the same columns: influences of all fits never leave a task."""
    rng = np.random.default_rng(2)
    n = 400
    data = [(str(a), str(b), *map(float, v)) for a, b, v in zip(rng.integers(0, 30, n), rng.integers(0, 20, n), rng.normal(size=(n, 4)))]
    df = spark.createDataFrame(data, "u string, i string, x0 double, x1 double, y0 double, y1 double")
    problems = [MO.Problem(f"{y}|{k}", x, (y,)) for y in ("y0", "y1") for k, x in enumerate((("x0",), ("x1",), ("x0", "x1")))]
    found = MO.moments(df, problems)
    fits = [MO.solve(found[(MO.ALL, p.name)], p.design, p.y[0], name=p.name, level=MO.ALL) for p in problems]
    widths = []
    real = type(df).mapInArrow

    def watched(frame, *args, **kwargs):
        widths.append(len(frame.columns))
        return real(frame, *args, **kwargs)

    monkeypatch.setattr(type(df), "mapInArrow", watched)
    MO.cluster_errors(df, fits, "u", "i")
    assert widths == [6, 5]  # (user, item) and item, each with two regressors and two outcomes
    assert all(f.kind == "two_way_cluster_user_item" and np.isfinite(f.covariance).all() for f in fits)


def test_columns_that_follow_from_others_are_not_shuffled(spark, monkeypatch):
    """Derived regressors exist on the sorted rows only; errors are those of the wide frame."""
    rng = np.random.default_rng(3)
    data = [(str(a), str(b), int(a % 4), *map(float, v)) for a, b, v in zip(rng.integers(0, 30, 400), rng.integers(0, 20, 400), rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(data, "u string, i string, h int, x double, y double")
    derive = lambda rows: rows.withColumns({f"x_at{k}": F.col("x") * (F.col("h") == k).cast("double") for k in range(4)})
    problem = MO.Problem("y", tuple(f"x_at{k}" for k in range(4)), ("y",))
    cross = MO.moments(derive(df), [problem])[(MO.ALL, "y")]
    fit = lambda: MO.solve(cross, problem.design, "y", name="y", level=MO.ALL)
    (wide,) = MO.cluster_errors(derive(df), [fit()], "u", "i")
    sent = []
    real = type(df).repartitionByRange

    def watched(frame, *args, **kwargs):
        sent.append(set(frame.columns))
        return real(frame, *args, **kwargs)

    monkeypatch.setattr(type(df), "repartitionByRange", watched)
    (narrow,) = MO.cluster_errors(df, [fit()], "u", "i", derive)
    assert sent == [{"u", "i", "h", "x", "y"}, {"i", "h", "x", "y"}]
    assert np.allclose(narrow.covariance, wide.covariance) and narrow.clusters == wide.clusters
