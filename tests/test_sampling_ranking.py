import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from funnelweir.functions.tails import normal_two_sided
from funnelweir.operators import agreement as AG
from funnelweir.operators import candidates as CA
from funnelweir.operators import describe as D
from funnelweir.operators import ranking as RK
from funnelweir.operators import recommend as RC
from funnelweir.operators import sampling as SA


def test_uniform_unseen_is_exact_on_tight_pools(spark, paths, monkeypatch):
    monkeypatch.setattr(SA, "WALK_BLOCK", 7)
    pool = spark.createDataFrame([(f"i{k}",) for k in range(50)], "item string")
    seen = [("hot", f"i{k}") for k in range(40)] + [("full", f"i{k}") for k in range(45)] + [("new", "zzz")]
    users = spark.createDataFrame([("hot",), ("full",), ("new",)], "user string")
    got = SA.uniform_unseen(users, "user", pool, "item", spark.createDataFrame(seen, "user string, item string"), 10, 3).toPandas()
    assert set(got[got.user == "hot"].item) == {f"i{k}" for k in range(40, 50)}
    assert "full" not in set(got.user)
    new = got[got.user == "new"]
    assert len(new) == new.item.nunique() == 10


def test_draws_are_close_to_uniform(spark):
    pool = spark.createDataFrame([(k,) for k in range(23)], "item int")
    users = spark.createDataFrame([(str(k),) for k in range(2000)], "user string")
    none = spark.createDataFrame([], "user string, item int")
    counts = SA.uniform_unseen(users, "user", pool, "item", none, 5, 1).groupBy("item").count().toPandas()["count"]
    expected = 2000 * 5 / 23
    assert ((counts - expected).abs() < 5 * math.sqrt(expected)).all() and len(counts) == 23


def test_rejection_second_round_and_limit(spark):
    pool = spark.createDataFrame([(str(k),) for k in range(20)], "item string")
    seen = spark.createDataFrame([("a", str(k)) for k in range(19)] + [("b", str(k)) for k in range(20)], "user string, item string")
    rows = spark.createDataFrame([("a",), ("b",)], "user string")
    got = SA.rejection_draws(rows, ["user"], "user", pool, "item", seen, 2, 1, 2, 400).collect()
    assert [r.user for r in got] == ["a", "a"] and {r.sampled_item for r in got} == {"19"}


def brute(scores, target):
    t = scores[target]
    tied = np.isclose(scores, t, rtol=1e-12, atol=1e-12)
    better = int(((scores > t) & ~tied).sum())
    places = np.arange(better + 1, better + tied.sum() + 1)
    return {f"hr_{k}": (places <= k).mean() for k in (10, 20)} | {
        f"ndcg_{k}": np.where(places <= k, 1 / np.log2(places + 1.0), 0).mean() for k in (10, 20)
    }


def test_expected_metrics_match_brute_force_and_ignore_shifts(spark):
    rng = np.random.default_rng(1)
    rows = []
    for u in range(30):
        values = rng.integers(0, 12, 40) / 10.0
        if u == 0:
            values[:] = 0.5
        rows += [("m", "s", str(u), i, float(v), i == 39) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "model string, stage string, user_id string, item_id int, score double, is_target boolean")
    base = {r.user_id: r for r in RK.expected_metrics(df).collect()}
    moved = {r.user_id: r for r in RK.expected_metrics(df.withColumn("score", F.col("score") + 3)).collect()}
    for u in range(30):
        values = np.array([r[4] for r in rows if r[2] == str(u)])
        for name, value in brute(values, 39).items():
            assert base[str(u)][name] == pytest.approx(value) == pytest.approx(moved[str(u)][name])
    assert base["0"].target_tie_size == 40


def test_paired_p_values_and_holm(spark):
    rng = np.random.default_rng(2)
    rows = [(m, "s", str(u), float(v)) for m, s in (("ours", 0.2), ("x", 0.0), ("y", 0.19)) for u, v in enumerate(rng.normal(s, 0.5, 300))]
    df = spark.createDataFrame(rows, "model string, stage string, user_id string, hr_10 double")
    got = {r.baseline: r for r in RK.paired_tests(df, "ours", ["hr_10"]).collect()}
    for r in got.values():
        assert r.p_value == pytest.approx(normal_two_sided(r.mean_difference / r.paired_se))
    assert got["x"].p_holm == pytest.approx(min(1, 2 * got["x"].p_value))
    assert got["x"].interpretation == "significantly higher"


def test_multi_positive_with_a_hot_user(spark):
    rng = np.random.default_rng(3)
    users = np.where(rng.random(900) < 1 / 3, "hot", rng.integers(0, 25, 900).astype(str))
    pdf = pd.DataFrame({"u": users, "y": rng.integers(0, 2, 900), "s": rng.integers(0, 9, 900) / 9.0, "o": np.arange(900)})
    got = RK.multi_positive_metrics(spark.createDataFrame(pdf), "u", "y", "s", "o").first()
    values = []
    for _, g in pdf.groupby("u"):
        if 0 < g.y.sum() < len(g):
            rel = g.sort_values(["s", "o"], ascending=[False, True]).y.to_numpy()[:10]
            ideal = np.ones(min(g.y.sum(), 10))
            gain = lambda a: (a / np.log2(np.arange(2, len(a) + 2))).sum()
            values.append(gain(rel) / gain(ideal))
    assert got.ranking_users == len(values) and got.ndcg_10 == pytest.approx(np.mean(values))


def test_stage_candidates_exclude_everything_seen(spark):
    rng = np.random.default_rng(5)
    cols = "user_id string, item_id string, timestamp long, y_click int, y_cart int, y_purchase int"
    make = lambda n, t: spark.createDataFrame(
        [(str(rng.integers(20)), str(rng.integers(60)), t + int(rng.integers(5)), 1, 1, int(rng.integers(2))) for _ in range(n)], cols
    )
    train, test = make(400, 10), make(200, 50)
    c = CA.stage_candidates(train, test, "purchase", 8, 1).toPandas()
    seen = {(r.user_id, r.item_id) for r in CA.seen_items(train, test).collect()}
    negatives = c[~c.is_target]
    assert not any((u, i) in seen for u, i in zip(negatives.user_id, negatives.item_id))
    assert (c.groupby("user_id").size() == 9).all() and (c.groupby("user_id").is_target.sum() == 1).all()
    assert CA.stage_candidates(train, test, "purchase", 8, 1, max_users=3).select("user_id").distinct().count() <= 3


def test_prior_maps_back_to_original_treatments(spark):
    rng = np.random.default_rng(6)
    n = 3000
    h = rng.normal(size=n)
    a = 0.5 * h + rng.normal(size=n)
    pdf = pd.DataFrame({"user_id": rng.integers(0, 99, n).astype(str), "item_id": "i", "res_T_con_mkt": h, "res_T_int_fac": a,
                        "res_y_click": 0.3 * h + 0.6 * a + rng.normal(size=n), "H_level": rng.integers(0, 2, n), "timestamp": np.arange(n)})
    df = spark.createDataFrame(pdf)
    rows = RC.causal_prior(df, ["res_y_click"], ["res_T_con_mkt"], ["res_T_int_fac"]).collect()
    direct = np.linalg.lstsq(np.column_stack([np.ones(n), h, a]), pdf.res_y_click, rcond=None)[0]
    total = {r.component: r.coefficient for r in rows if r.h_level == "ALL"}
    assert total["T_con_mkt"] == pytest.approx(direct[1]) and total["T_int_fac"] == pytest.approx(direct[2])
    gate = RC.prior_stability(df, "timestamp", ["res_y_click"], ["res_T_con_mkt"], ["res_T_int_fac"], 0.5, 0.5).first()
    assert gate.sign_agreement == 1.0 and gate.gate_passed


def test_rank_permutation_matches_pandas_rho(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 400), "id": np.arange(400), "a": rng.integers(0, 9, 400).astype(float)})
    pdf["b"] = np.where(pdf.g == 1, pdf.a + rng.integers(0, 4, 400), rng.integers(0, 9, 400)).astype(float)
    got = AG.spearman_permutation(spark.createDataFrame(pdf), "a", "b", ["g"], "id", 99).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g, "spearman_rho"] == pytest.approx(part.a.rank().corr(part.b.rank()))
    assert got.loc[1, "spearman_p"] == pytest.approx(0.01) and got.loc[0, "spearman_p"] > 0.02


def test_rank_permutation_holds_its_level_and_rejects_small_groups(spark):
    rng = np.random.default_rng(11)
    rows = [(f"null{g}", i, float(a), float(b)) for g in range(300) for i, (a, b) in enumerate(rng.normal(size=(12, 2)))]
    rows += [("equal", i, float(i), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, id long, a double, b double")
    got = AG.spearman_permutation(df, "a", "b", ["g"], "id", 199).toPandas().set_index("g").spearman_p
    assert got["equal"] == pytest.approx(0.005)
    assert 0.015 <= (got.drop("equal") <= 0.05).mean() <= 0.09


def test_kappa_matches_the_cell_table(spark):
    rng = np.random.default_rng(8)
    a, b = rng.random(300) * 10, rng.random(300) * 10
    got = spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).agg(AG.weighted_kappa(F.col("a"), F.col("b")).alias("k")).first().k
    left, right = np.rint(a).astype(int), np.rint(b).astype(int)
    seen = np.zeros((11, 11))
    np.add.at(seen, (left, right), 1)
    weights = np.subtract.outer(np.arange(11), np.arange(11)) ** 2 / 100
    chance = np.outer(seen.sum(1), seen.sum(0)) / 300
    assert got == pytest.approx(1 - (weights * seen).sum() / (weights * chance).sum())


def test_rater_files_are_checked(spark):
    frame = lambda r, s: spark.createDataFrame([(r, s)], "rater_id string, score double")
    assert AG.combine_raters([frame("A", 1.0), frame("B", 2.0)], ["A", "B"]).count() == 2
    for bad in ([frame("A", 1.0)], [frame("A", 1.0), frame("A", 1.0)], [frame("A", 1.0), frame("B", None)]):
        with pytest.raises(ValueError):
            AG.combine_raters(bad, ["A", "B"])


def test_only_rows_left_short_draw_again(spark, monkeypatch):
    """The first round stores one draw per row and later ones only what is short; draws are those of all attempts at once."""
    sizes, kept = [], SA.stored
    monkeypatch.setattr(SA, "stored", lambda df: (sizes.append(df.count()), kept(df))[1])
    pool = spark.createDataFrame([(f"{i:02}",) for i in range(20)], "item string")
    pairs = [(f"u{u}", f"{i:02}") for u in range(40) for i in range(u % 4, 20, 4)]
    rows = spark.createDataFrame(pairs, "user string, item string").repartition(3)
    got = {(r.user, r.item): (r.negative, r.attempt) for r in SA.rejection_draws(rows, ["user", "item"], "user", pool, "item", rows, 1, 5, 4, 60, "negative", True).collect()}
    draw = lambda u, i, a: f"{int(hashlib.md5(f'5|{u}|{i}|{a}'.encode()).hexdigest()[:12], 16) % 20:02}"
    expected = {}
    for u, i in pairs:
        expected[u, i] = next((draw(u, i, a), a) for a in range(1, 61) if (u, draw(u, i, a)) not in set(pairs))
    assert got == expected
    short = sum(a > 1 for _, a in expected.values())
    assert sizes[:2] == [len(pairs), 3 * short]


def test_walks_are_replayed_and_only_met_steps_are_rows(spark, monkeypatch):
    """Same draws as a step-by-step walk, users of one and of several blocks; what is stored is a row per block."""
    monkeypatch.setattr(SA, "WALK_BLOCK", 8)
    names = [f"i{k:02}" for k in range(50)]  # 53 is the next prime
    seen = {f"u{u}": set(names[u : u + 4 * u]) for u in range(10)} | {"full": set(names[:46])}
    frame = spark.createDataFrame([(u, i) for u, own in seen.items() for i in [*own, "other"]], "user string, item string").repartition(3)
    pool = spark.createDataFrame([(n,) for n in names], "item string")
    places, indexed = SA.unseen_places(frame, "user", pool, "item", frame, 6, 3)
    got = {}
    for r in SA.named_places(places, "user", indexed, "item").collect():
        got.setdefault(r.user, {})[r.draw] = r.item
    number = lambda what, u, n: int(hashlib.md5(f"3|{what}|{u}".encode()).hexdigest()[:12], 16) % n
    expected = {}
    for u, own in seen.items():
        walk = [(number("stride", u, 52) + 1) * j + number("start", u, 53) for j in range(53)]
        fresh = [names[p % 53] for p in walk if p % 53 < 50 and names[p % 53] not in own]
        if len(fresh) >= 6:
            expected[u] = dict(enumerate(fresh[:6], 1))
    assert got == expected and "full" not in got
    assert places.count() < 3 * len(expected)


def test_weights_are_measured_without_shuffling_their_product(spark):
    """Ties, a missing causal score and a list shorter than ten, against NumPy; no exchange by weight."""
    rng = np.random.default_rng(2)
    rows = [("s", f"u{u}", f"{i:02}", i == u % 7, float(rng.integers(0, 4)), None if i == 3 and u % 7 != 3 else float(rng.integers(0, 3))) for u in range(12) for i in range(7 + u)]
    df = spark.createDataFrame(rows, "stage string, user_id string, item_id string, is_target boolean, relevance double, causal double")
    calibrations = spark.createDataFrame([("s", 1.5, 1.1, 1.0, 0.8)], "stage string, relevance_mean double, relevance_sd double, causal_mean double, causal_sd double")
    gates = spark.createDataFrame([("s", True)], "stage string, gate_passed boolean")
    table = RC.select_weight(df, calibrations, [0.0, 0.5, 2.0], gates, 0.9)
    assert "hashpartitioning(weight" not in table._jdf.queryExecution().executedPlan().toString()
    got = {r.weight: r for r in table.collect()}
    for w in (0.0, 0.5, 2.0):
        ndcg, use = [], []
        for u in range(12):
            own = [(i, t, None if c is None else (r - 1.5) / 1.1 + w * (c - 1.0) / 0.8, c) for _, v, i, t, r, c in rows if v == f"u{u}"]
            known = [x for x in own if x[2] is not None]
            score = next((x[2] for x in own if x[1]), None)
            tie = [abs(x[2] - score) <= 1e-12 + 1e-12 * abs(score) for x in known] if score is not None else []
            if sum(tie) == 0:
                continue
            first = sum(x[2] > score and not t for x, t in zip(known, tie, strict=True))
            ndcg.append(sum(1 / math.log2(p + 1) for p in range(first + 1, min(10, first + sum(tie)) + 1)) / sum(tie))
            top = sorted(own, key=lambda x: (x[2] is None, -(x[2] or 0.0), x[1], x[0]))[:10]
            gain = [1 / math.log2(k + 2) for k in range(len(top))]
            use.append(sum(g * x[3] for g, x in zip(gain, top, strict=True) if x[3] is not None) / sum(gain))
        assert abs(got[w].ndcg_10 - np.mean(ndcg)) < 1e-9 and got[w].validation_users == len(ndcg), w
        assert abs(got[w].mean_causal_score - np.mean(use)) < 1e-9, w


def test_walks_state_their_tasks(spark):
    """Small tables of walkers are not merged into one task that makes all steps, and the steps made are not shuffled."""
    users = spark.range(40).select(F.col("id").cast("string").alias("u"))
    pool = spark.range(60).select(F.col("id").cast("string").alias("i"))
    seen = spark.createDataFrame([(str(u), str((u * 7 + j) % 60)) for u in range(40) for j in range(u)], "u string, i string")
    places, _ = SA.unseen_places(users, "u", pool, "i", seen, 30, "s")
    files = len(set(places.inputFiles()))
    assert files > 1 and places.agg(F.sum(F.size("_places"))).first()[0] == 30 * places.count() == 30 * 31


def test_shares_of_few_values_do_not_shuffle_the_rows(spark):
    rows = spark.createDataFrame([(p, t) for p, t in zip("aabbbc", (1, 1, 1, 0, 1, 0), strict=True)] + [(None, 1)], "p string, t int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = D.train_frequency(rows, "p", F.col("t") == 1, "share")
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # a missing value counts in the whole, but meets no share
    found = {(r["p"], round(r["share"], 6)) for r in out.collect()}
    assert found == {("a", 0.4), ("b", 0.4), ("c", 0.0), (None, 0.0)}
