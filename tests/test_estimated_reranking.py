"""Re-ranking on the estimated prior: policies in one pass against a loop, the chain against its steps."""

import numpy as np
import pandas as pd
import pytest

from funnelweir.operators import recommend as RC

CUES = ["T_con_mkt", "T_int_fac"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    n = 600
    pdf = pd.DataFrame({"user_id": rng.integers(0, 80, n).astype(str), "item_id": rng.integers(0, 50, n).astype(str), "timestamp": rng.integers(0, 30, n)})
    for c in CUES:
        pdf[c] = rng.integers(0, 5, n) / 4.0  # ties
    pdf.loc[::9, "T_int_fac"] = np.nan
    for y in ("y_click", "y_cart", "y_purchase"):
        pdf[y] = rng.integers(0, 2, n).astype(float)
    return pdf.drop_duplicates(["user_id", "item_id", "timestamp"])


def test_policies_in_one_pass_equal_a_loop(spark, rows):
    theta = {"T_con_mkt": (0.3, 0.05), "T_int_fac": (-0.2, 0.02)}
    scores = {"a": {"T_con_mkt": 0.3, "T_int_fac": -0.2}, "b": {"T_con_mkt": -0.1, "T_int_fac": 0.4}, "c": {"T_int_fac": 1.0}}
    df = spark.createDataFrame(rows).selectExpr("* except (T_int_fac)", "nullif(T_int_fac, double('NaN')) AS T_int_fac")
    parameters = spark.createDataFrame([(p, t, v) for p, own in scores.items() for t, v in own.items()], "policy string, treatment string, coefficient double")
    values = spark.createDataFrame([(t, *v) for t, v in theta.items()], "treatment string, coefficient double, std_error double")
    got = RC.estimated_policies(df, parameters, values, CUES, reps=4000).toPandas().set_index("policy")
    want = RC.policy_table(df, {p: RC.lift(own) for p, own in scores.items()}, theta, reps=4000).toPandas().set_index("policy")
    assert set(got.index) == set("abc")
    for c in ("users", "items", "candidate_rows", "click_rate", "cart_rate", "purchase_rate", "mean_lift"):
        assert np.allclose(got[c].astype(float), want[c][got.index].astype(float)), c
    assert np.allclose(got.lift_lower, want.lift_lower[got.index], atol=0.01) and np.allclose(got.lift_upper, want.lift_upper[got.index], atol=0.01)


def test_choices_without_parameters_or_rows(spark, rows):
    df = spark.createDataFrame(rows)
    none = spark.createDataFrame([], "policy string, treatment string, coefficient double")
    some = spark.createDataFrame([("a", "T_con_mkt", 1.0)], "policy string, treatment string, coefficient double")
    assert RC.policy_choices(df, none, CUES).count() == 0
    assert RC.policy_choices(df.filter("1 = 0"), some, CUES).count() == 0
    assert RC.policy_choices(df, some, CUES).count() == rows.user_id.nunique()


def test_chain_uses_the_estimated_prior_and_the_selected_weight(spark):
    rng = np.random.default_rng(4)
    n = 4000
    r = pd.DataFrame({"user_id": (np.arange(n) % 200).astype(str), "item_id": (np.arange(n) % 90).astype(str), "timestamp": np.arange(n), "H_level": np.arange(n) % 3})
    r["res_T_con_mkt"], r["res_T_int_fac"] = rng.normal(size=n), rng.normal(size=n)
    r["res_y_purchase"] = 0.5 * r.res_T_con_mkt - 0.3 * r.res_T_int_fac + rng.normal(size=n)
    residuals = spark.createDataFrame(r)
    profiles = pd.DataFrame({"item_id": [str(i) for i in range(90)], "T_con_mkt": rng.normal(size=90), "T_int_fac": rng.normal(size=90)})
    cands = pd.DataFrame([("purchase", str(u), str(i), i == u % 90, float(i == u % 90) + rng.random()) for u in range(60) for i in {*rng.choice(90, 15, False).tolist(), u % 90}], columns=["stage", "user_id", "item_id", "is_target", "relevance"])
    levels = spark.createDataFrame([(str(u), u % 4) for u in range(60)], "user_id string, level int")
    scores, prior, gates, table = RC.estimated_reranking(
        spark.createDataFrame(cands), spark.createDataFrame(profiles), levels, residuals, ["res_y_purchase"], ["res_T_con_mkt"], ["res_T_int_fac"], "timestamp", [0.0, 0.1, 5.0], 0.9, 0.5, -1.0
    )
    p = prior.toPandas().set_index(["h_level", "component"]).coefficient
    assert abs(p["ALL", "T_con_mkt"] - 0.5) < 0.06 and abs(p["ALL", "T_int_fac"] + 0.3) < 0.06
    assert gates.first().gate_passed
    chosen = table.filter("selected").first()
    assert chosen.weight in (0.0, 0.1) and table.filter("weight = 5.0").first().eligible is False
    out = scores.toPandas().merge(profiles, on="item_id")
    level = (out.user_id.astype(int) % 4).map(lambda v: str(v) if v < 3 else "ALL")
    causal = [p[lv, "T_con_mkt"] * a + p[lv, "T_int_fac"] * b for lv, a, b in zip(level, out.T_con_mkt, out.T_int_fac, strict=True)]
    assert np.allclose(out.causal, causal)
    z = lambda c: (c - c.mean()) / c.std(ddof=0)
    assert np.allclose(out.score, z(out.relevance) + chosen.weight * z(out.causal))


def test_prior_and_stability_read_their_rows_once(spark):
    """Several passes follow, but the residuals' own plan runs once for each."""
    rng = np.random.default_rng(6)
    n = 2400
    pdf = pd.DataFrame({"timestamp": np.arange(n), "H_level": np.arange(n) % 2, "res_T_con_mkt": rng.normal(size=n), "res_T_int_fac": rng.normal(size=n)})
    pdf["res_y_purchase"] = 0.4 * pdf.res_T_con_mkt + rng.normal(size=n)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(pdf)
    counted = frame.mapInArrow(count, frame.schema)
    names = (["res_y_purchase"], ["res_T_con_mkt"], ["res_T_int_fac"])
    RC.causal_prior(counted, *names).collect()
    assert read.value == n
    RC.prior_stability(counted, "timestamp", *names, 0.5, -1.0).collect()
    assert read.value == 2 * n


def test_policy_table_reads_its_rows_once(spark, rows):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(rows)
    table = RC.policy_table(frame.mapInArrow(count, frame.schema), {"a": RC.lift({"T_con_mkt": 0.3}), "b": RC.lift({"T_int_fac": 0.4})}, {"T_con_mkt": (0.3, 0.05)})
    assert table.count() == 2 and read.value == len(rows)
