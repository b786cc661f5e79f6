import numpy as np
import pandas as pd
import pytest

from funnelweir.operators import history as H
from funnelweir.operators import ordering as O
from funnelweir.operators import ranks as R
from funnelweir.operators import splits as SP


def skewed_events(n=3000, seed=1):
    """One user holds a third of all rows; days repeat."""
    rng = np.random.default_rng(seed)
    user = np.where(rng.random(n) < 1 / 3, "hot", rng.integers(0, 40, n).astype(str))
    return pd.DataFrame(
        {
            "user_id": user,
            "item_id": rng.integers(0, 30, n).astype(str),
            "timestamp": 20200100 + rng.integers(1, 29, n),
            "y_click": rng.integers(0, 2, n),
            "category": rng.integers(0, 4, n).astype(str),
        }
    )


@pytest.mark.parametrize("few_times", [True, False])
def test_prior_counts_use_strictly_earlier_rows_only(spark, paths, few_times):
    pdf = skewed_events().reset_index(names="row")
    out = H.prior_counts(spark.createDataFrame(pdf), "user_id", "timestamp", {"clicks": "y_click"}, few_times).toPandas()
    got = out.set_index("row")[["events_pre", "clicks_pre"]]
    for row in pdf.sample(60, random_state=0).itertuples():
        earlier = pdf[(pdf.user_id == row.user_id) & (pdf.timestamp < row.timestamp)]
        assert got.loc[row.row, "events_pre"] == len(earlier)
        assert got.loc[row.row, "clicks_pre"] == earlier.y_click.sum()


def test_affinity_and_missing_policy(spark):
    pdf = skewed_events().reset_index(names="row")
    df = spark.createDataFrame(pdf)
    filled = H.category_affinity(df, "user_id", "category", "timestamp", "y_click").toPandas().set_index("row")
    open_ = H.category_affinity(df, "user_id", "category", "timestamp", "y_click", missing=None).toPandas().set_index("row")
    for row in pdf.sample(60, random_state=1).itertuples():
        earlier = pdf[(pdf.user_id == row.user_id) & (pdf.timestamp < row.timestamp) & (pdf.y_click == 1)]
        if len(earlier):
            share = (earlier.category == row.category).mean()
            assert filled.loc[row.row, "T_int_sem"] == pytest.approx(share)
        else:
            assert filled.loc[row.row, "T_int_sem"] == 0.01
            assert np.isnan(open_.loc[row.row, "T_int_sem"]) and open_.loc[row.row, "T_int_sem_available"] == 0


def test_asof_excludes_the_same_time_and_missing_history(spark, paths):
    events = spark.createDataFrame([("a", 5), ("a", 6), ("b", 9)], "item_id string, timestamp long")
    ratings = spark.createDataFrame([("a", 5, 4.0), ("a", 5, 2.0), ("a", 1, None)], "item_id string, timestamp long, rating double")
    got = {(r.item_id, r.timestamp): r for r in H.rating_history(events, ratings, few_times=not paths).collect()}
    assert got[("a", 5)].item_review_count_pre == 1 and got[("a", 5)].item_rating_mean_pre is None
    assert got[("a", 6)].item_review_count_pre == 3 and got[("a", 6)].item_rating_mean_pre == pytest.approx(2.0)
    assert not got[("b", 9)].item_review_count_pre


def test_splits_share_no_timestamp_and_handle_edges(spark, paths):
    df = spark.createDataFrame(skewed_events())
    out = SP.temporal_split(df, "timestamp").toPandas()
    days = {s: set(g.timestamp) for s, g in out.groupby("split")}
    assert not (days["A"] & days["B"]) and not (days["B"] & days["C"])
    assert max(days["A"]) < min(days["B"]) and max(days["B"]) < min(days["C"])
    one = spark.createDataFrame([(1,)] * 10, "timestamp long")
    assert {r.split for r in SP.temporal_split(one, "timestamp").collect()} == {"A"}
    single = spark.createDataFrame([(1,)], "timestamp long")
    assert [r.split for r in SP.temporal_split(single, "timestamp").collect()] == ["A"]


def test_rank_keeps_zeros_and_is_a_permutation(spark, paths):
    rng = np.random.default_rng(3)
    values = np.where(rng.random(900) < 1 / 3, 0.5, rng.integers(0, 5, 900) / 10.0)
    pdf = pd.DataFrame({"id": np.arange(900), "v": values, "g": rng.integers(0, 2, 900)})
    df = spark.createDataFrame(pdf)
    whole = R.zero_preserving_rank(df, "v", ["id"], "s").toPandas()
    positive = whole[whole.v > 0]
    assert (whole[whole.v == 0].s == 0).all()
    assert np.allclose(np.sort(positive.s), np.arange(1, len(positive) + 1) / len(positive))
    assert positive.groupby("v").s.min().is_monotonic_increasing
    grouped = R.zero_preserving_rank(df, "v", ["id"], "s", by=["g"]).toPandas()
    for _, part in grouped[grouped.v > 0].groupby("g"):
        assert np.allclose(np.sort(part.s), np.arange(1, len(part) + 1) / len(part))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": np.concatenate([rng.normal(size=700), np.full(350, 0.25)]), "g": rng.integers(0, 3, 1050)})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.99, 1.0]
    assert np.allclose(O.quantile_scalars(df, "x", probs), np.quantile(pdf.x, probs))
    for r in O.exact_quantiles(df, ["x"], probs, ["g"]).collect():
        assert np.allclose([r[f"p{i}"] for i in range(6)], np.quantile(pdf.x[pdf.g == r["g"]], probs))


@pytest.mark.parametrize("few", [0, 10_000])
def test_quantiles_of_large_and_of_many_groups(spark, monkeypatch, few):
    """A hot group beyond the bracket's least size, thousands of small ones, a null group, hot values, gaps."""
    monkeypatch.setattr(O, "BROADCAST_ROWS", few)
    rng = np.random.default_rng(6)
    n = 90_000
    group = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 3000, n))
    x = np.where(rng.random(n) < 1 / 3, 0.0, rng.lognormal(0, 4, n) * rng.choice([-1, 1], n))
    x[::50] = np.nan
    pdf = pd.DataFrame({"g": group, "x": x, "y": rng.integers(0, 5, n).astype(float)})
    df = spark.createDataFrame(pdf).selectExpr("nullif(g, 7) AS g", "nullif(x, double('NaN')) AS x", "y").repartition(7)
    probs = [0.0, 0.0101, 0.25, 0.5, 0.75, 0.9907, 1.0]
    out = {(r["g"], r["name"]): [r[f"p{i}"] for i in range(7)] for r in O.exact_quantiles(df, ["x", "y"], probs, ["g"]).collect()}
    pdf["g"] = pdf.g.where(pdf.g != 7)
    expected = {(None if pd.isna(g) else int(g), c): np.quantile(part[c].dropna(), probs) for g, part in pdf.groupby("g", dropna=False) for c in ("x", "y") if part[c].notna().any()}
    assert out.keys() == expected.keys()
    for k, v in expected.items():
        assert np.allclose(out[k], v, rtol=1e-12), k


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "g int, x double")
    assert O.exact_quantiles(df.filter("1 = 0"), ["x"], [0.5]).collect() == []
    assert [tuple(r) for r in O.exact_quantiles(df, ["x"], [0.5], ["g"]).collect()] == [(2, "x", 3.0)]


def test_history_level_rules(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4)], "x double")
    level = lambda cuts: [r[0] for r in df.select(R.history_level("x", cuts)).collect()]
    assert level([2.0, 3.0]) == [0, 1, 2, 3, 3]
    assert level([2.0]) == [0, 1, 1, 2, 2]
    assert level([]) == [0, 1, 1, 1, 1]


def test_stored_rows_are_compressed_columns_in_the_shared_folder(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from funnelweir.session import stored

    df = spark.range(20_000).selectExpr("id", "id % 7 AS k", "IF(id % 3 = 0, NULL, 0.5D) AS v", "CAST(id % 5 AS STRING) AS s")
    kept = stored(df)
    assert kept.dtypes == df.dtypes and kept.exceptAll(df).isEmpty() and kept.count() == 20_000
    files = {Path(urlparse(f).path).parent for f in kept.inputFiles()}
    assert {f.parent for f in files} == {Path(urlparse(spark.sparkContext.getCheckpointDir()).path)}
    assert sum(p.stat().st_size for f in files for p in f.glob("*.parquet")) < 20_000 * 16


def test_rank_stores_neither_hash_nor_order_columns(spark, monkeypatch):
    from funnelweir.operators import ordering

    seen = []
    real = ordering.stored
    monkeypatch.setattr(ordering, "stored", lambda df: seen.append(df.columns) or real(df))
    df = spark.createDataFrame([(str(i), float(i % 4)) for i in range(50)], "id string, v double")
    scores = sorted(r["s"] for r in R.zero_preserving_rank(df, "v", ["id"], "s").collect() if r["s"] > 0)
    assert seen == [["id", "v", "_pos1", "__pid", "__pos"]]
    assert scores == [k / 37 for k in range(1, 38)]


def test_user_days_hold_both_histories_after_one_shuffle_by_user(spark):
    rows = [(u, c, t, int((u + t + k) % 3 == 0)) for u in range(4) for t in (1, 2, 2, 5, 9) for k, c in enumerate("ab") if (u + t) % 4]
    df = spark.createDataFrame([(str(u), c, t, y) for u, c, t, y in [*rows, (1, "a", None, 1)]], "user_id string, category string, timestamp long, y_click int")
    days = H.user_days(df, "user_id", "category", "timestamp", {"clicks": "y_click"}, "clicks")
    assert days._jdf.queryExecution().sparkPlan().toString().count("Window [") == 2
    assert days._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = {(r.user_id, r.category, r.timestamp): r for r in days.collect()}
    assert sum(r["_rows"] for r in got.values()) == len(rows) + 1
    for (u, c, t), r in got.items():
        if t is None:
            assert r.events_pre is r.clicks_pre is r.T_int_sem is None
            continue
        before = [x for x in rows if str(x[0]) == u and x[2] < t]
        clicks, own = sum(x[3] for x in before), sum(x[3] for x in before if x[1] == c)
        assert (r.events_pre, r.clicks_pre, r.history_max_ts) == (len(before), clicks, max((x[2] for x in before), default=None))
        assert abs(r.T_int_sem - (own / clicks if clicks else 0.01)) < 1e-12


def test_asof_points_meet_before_they_shrink(spark):
    events = spark.createDataFrame([("a", 3), ("a", 3), ("a", 7), ("b", 1)], "item_id string, timestamp long")
    ratings = spark.createDataFrame([("a", 1, 2.0), ("a", 3, 5.0), ("a", 3, None), ("c", 1, 4.0)], "item_id string, timestamp long, rating double")
    points = H.rating_points(events, ratings)
    assert points._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = {(r.item_id, r.timestamp): (r.item_review_count_pre, r.item_rating_mean_pre) for r in points.collect()}
    assert got == {("a", 3): (1, 2.0), ("a", 7): (3, 7.0 / 3), ("b", 1): (0, None)}
