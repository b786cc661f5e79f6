import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from funnelweir.functions import bijection as BJ
from funnelweir.functions import tails as T
from funnelweir.operators import diagnostics as DG
from funnelweir.operators import effects as E
from funnelweir.operators import moments as MO
from funnelweir.operators import multitest as MT
from funnelweir.operators import nuisance as N
from funnelweir.operators import projection as PJ
from funnelweir.operators import resampling as RS
from funnelweir.operators import sensitivity as SE


def sample(n=2400, seed=2, effect=0.7):
    """Residuals with a known effect of the third cue; one user holds a third of the rows."""
    rng = np.random.default_rng(seed)
    user = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 160, n))
    h = rng.normal(size=(n, 2))
    fac = 0.4 * h[:, 0] - 0.2 * h[:, 1] + rng.normal(size=n)
    y = effect * fac + 0.3 * h[:, 0] + rng.normal(size=160)[user] * 0.1 + rng.normal(size=n)
    return pd.DataFrame(
        {
            "user_id": user.astype(str),
            "item_id": rng.integers(0, 120, n).astype(str),
            "res_T_con_mkt": h[:, 0],
            "res_T_con_soc": h[:, 1],
            "res_T_int_fac": fac,
            "res_y_purchase": y,
            "H_level": rng.integers(0, 4, n),
        }
    )


CUES = ["res_T_con_mkt", "res_T_con_soc", "res_T_int_fac"]


def numpy_two_way(pdf, y, xs):
    x = np.column_stack([np.ones(len(pdf)), pdf[xs].to_numpy()])
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ pdf[y].to_numpy()
    scores = x * (pdf[y].to_numpy() - x @ beta)[:, None]
    n, k = x.shape

    def part(codes):
        sums = pd.DataFrame(scores).groupby(codes).sum().to_numpy()
        g = len(sums)
        return g / (g - 1) * (n - 1) / (n - k) * bread @ sums.T @ sums @ bread

    u, i = pdf.user_id.to_numpy(), pdf.item_id.to_numpy()
    pair = np.array([f"{a}|{b}" for a, b in zip(u, i)])
    return beta, part(u) + part(i) - part(pair)


def test_two_way_errors_equal_numpy(spark):
    pdf = sample()
    rows = {r.treatment: r for r in E.weighted_effects(spark.createDataFrame(pdf), ["res_y_purchase"], CUES).collect()}
    beta, cov = numpy_two_way(pdf, "res_y_purchase", CUES)
    for i, c in enumerate(CUES, 1):
        assert rows[c].coefficient == pytest.approx(beta[i])
        assert rows[c].std_error == pytest.approx(math.sqrt(cov[i, i]))
        assert rows[c].covariance == "two_way_cluster_user_item"


def test_known_effect_is_recovered_after_projection(spark):
    train, final = spark.createDataFrame(sample(1500, 7)), spark.createDataFrame(sample())
    out, columns, report, _ = PJ.fit_apply(train, final, CUES[:2], CUES[2:])
    assert [r.status for r in report.collect()] == ["fitted_on_A_to_B_residuals"]
    rows = {r.component: r for r in E.family(out, ["res_y_purchase"], columns).collect()}
    assert rows["T_int_fac"].coefficient == pytest.approx(0.7, abs=0.08)
    few = train.limit(5)
    _, _, report, fitted = PJ.fit_apply(few, final, CUES[:2], CUES[2:])
    assert fitted["res_T_int_fac"]["parameters"] is None
    assert report.first().status == "insufficient_training_support"


def test_family_reports_skipped_treatments_and_levels(spark):
    pdf = sample().assign(res_flat=0.001)
    rows = E.family(spark.createDataFrame(pdf), ["res_y_purchase"], [*CUES, "res_flat"], by="H_level").collect()
    flat = [r for r in rows if r.treatment == "res_flat"]
    assert {r.h_level for r in rows} == {"ALL", "0", "1", "2", "3"} and len(flat) == 5
    assert all(r.coefficient is None and not r.estimable and "low_residual_sd" in r.support_flag for r in flat)
    level = pdf[pdf.H_level == 1]
    beta, cov = numpy_two_way(level, "res_y_purchase", CUES)
    got = next(r for r in rows if r.h_level == "1" and r.treatment == CUES[2])
    assert (got.coefficient, got.std_error) == (pytest.approx(beta[3]), pytest.approx(math.sqrt(cov[3, 3])))


def test_tail_functions():
    assert T.chi2_sf(5.991464547107979, 2) == pytest.approx(0.05)
    assert T.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert T.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert T.student_quantile(0.975, 4) == pytest.approx(2.7764451051977987)
    assert T.student_quantile(0.975, 5) == pytest.approx(2.5705818366147395)


def test_wald_uses_the_covariance_rank(spark):
    fit = MO.Fit("f", "y", ["a", "b"], np.array([1.0, 1.0]), np.eye(2), 10, 1.0, 1.0)
    fit.covariance = np.ones((2, 2))
    assert E.wald(fit, ["a", "b"])["df"] == 1
    fit.covariance = np.eye(2)
    assert E.wald(fit, ["a", "b"])["statistic"] == pytest.approx(2.0)


def test_holm_ignores_missing(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (None,), (0.03,)], "p double")
    got = {r.p: r.p_holm for r in MT.holm(df, "p").collect()}
    assert got[0.01] == pytest.approx(0.03) and got[0.03] == pytest.approx(0.06) and got[0.04] == pytest.approx(0.06)
    assert got[None] is None


def test_bootstrap_weights_every_replicate_fully(spark, paths):
    pdf = sample(900)
    df = spark.createDataFrame(pdf)
    stats, names = RS.cluster_sums(df, "user_id", [CUES[2]], ["res_y_purchase"])
    sums = RS.bootstrap_sums(stats, names, "user_id", 30, 4).toPandas()
    assert len(sums) == 30 and (sums.clusters == pdf.user_id.nunique()).all()
    interval = RS.bootstrap_interval(df, "res_y_purchase", [CUES[2]], 60, 4).first()
    assert interval.boot_lower < 0.8 < interval.boot_upper + 0.2 and interval.successes == 60
    assert RS.bootstrap_interval(df, "res_y_purchase", [CUES[2]], 10, 4).first().boot_lower is None


def test_permutations_keep_the_null_centred(spark):
    pdf = sample().reset_index(names="k")
    draws = RS.permutation_coefficients(spark.createDataFrame(pdf), ["res_y_purchase"], CUES, ["k"], 30, 9).toPandas()
    fac = draws[draws.treatment == CUES[2]].coefficient
    assert len(fac) == 30 and fac.nunique() == 30 and abs(fac.mean()) < 0.05
    assert (fac.abs() < 0.5).all()


def test_permutations_equal_brute_force(spark):
    pdf = sample(500).reset_index(names="k")
    draws = RS.permutation_coefficients(spark.createDataFrame(pdf), ["res_y_purchase"], CUES, ["k"], 3, 9).toPandas()
    x, y = pdf[CUES].to_numpy(), pdf["res_y_purchase"].to_numpy()
    for rep in (1, 2, 3):
        n = len(pdf)
        to = BJ.permuted(np.arange(n), np.full(n, n), np.zeros(n, int), rep, 9)
        moved = np.empty_like(x)
        moved[to] = x
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(y)), moved]), y, rcond=None)[0][1:]
        got = draws[draws.rep == rep].set_index("treatment").coefficient
        assert np.allclose([got[c] for c in CUES], beta)


@pytest.mark.parametrize("n", [10, 50])
def test_small_groups_have_distinct_permutations(spark, n):
    x = np.sqrt(np.arange(1.0, n + 1))  # sums of products tell permutations apart
    df = spark.createDataFrame(pd.DataFrame({"k": range(n), "x": x, "y": np.log(np.arange(1.0, n + 1) + 0.3)}))
    draws = RS.permuted_products(df, ["x"], ["y"], ["k"], 400, 5).toPandas()
    assert len(draws) == 400 and draws.v.round(9).nunique() >= 398


def test_wild_draws_have_cluster_spread(spark):
    pdf = sample()
    df = spark.createDataFrame(pdf)
    fit = E.fit_designs(E.numeric_columns(df, ["res_y_purchase", *CUES]), [MO.Problem("p", tuple(CUES), ("res_y_purchase",))])[0]
    beta, sigma2, nu2 = RS.wild_draws(df, fit, CUES, 400, 3)
    x = np.column_stack([np.ones(len(pdf)), pdf[CUES]])
    bread = np.linalg.inv(x.T @ x)
    scores = x * (pdf.res_y_purchase.to_numpy() - x @ fit.beta)[:, None]
    sums = pd.DataFrame(scores).groupby(pdf.user_id.to_numpy()).sum().to_numpy() @ bread
    assert np.allclose(beta.mean(axis=0), fit.beta[1:], atol=0.03)
    assert np.allclose(beta.std(axis=0), np.sqrt((sums**2).sum(axis=0))[1:], rtol=0.15)
    assert sigma2.mean() == pytest.approx(fit.sse / fit.n, rel=0.05) and (nu2 > 0).all()


def test_bound_arithmetic():
    assert SE.strength(0.1, 0.0) == 0.0
    r = SE.equal_strength(0.3, 1.0)
    assert r / math.sqrt(1 - r) == pytest.approx(0.3)
    same = {"sigma2": 1.0, "nu2": 1.0, "theta": 0.5}
    assert SE.gains(same, same)["cf_y"] == 0.0


def test_calibration_line_recovers_a_known_distortion(spark):
    rng = np.random.default_rng(4)
    logit = rng.normal(size=6000)
    y = rng.random(6000) < 1 / (1 + np.exp(-(0.4 + 0.6 * logit)))
    df = spark.createDataFrame(pd.DataFrame({"y": y.astype(int), "p": 1 / (1 + np.exp(-logit))}))
    a, b = DG.calibration_line(df, "y", "p")
    assert a == pytest.approx(0.4, abs=0.1) and b == pytest.approx(0.6, abs=0.1)


def test_learners_beat_the_mean_and_constants_pass_through(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": rng.random(800), "one": 0.5})
    pdf["t"] = np.where(rng.random(800) < 0.9, pdf.x, np.nan)
    pdf["y"] = (rng.random(800) < pdf.x).astype(int)
    train, test = spark.createDataFrame(pdf[:400]), spark.createDataFrame(pdf[400:])
    for learner in ("ridge", "boosted"):
        out = N.residualize(train, test, ["t", "one"], ["x"], "treatment", learner, {"trees": 40, "depth": 3, "rate": 0.1} if learner == "boosted" else None)
        metrics = {r.target: r for r in N.fit_metrics(out, ["t", "one"]).collect()}
        assert metrics["t"].r2 > 0.8 and metrics["one"].rmse == pytest.approx(0, abs=1e-6)
        assert out.filter("t IS NULL AND mhat_t IS NOT NULL").count() == 0
    for learner in ("ridge", "logistic"):
        out = N.residualize(train, test, ["y"], ["x"], "outcome", learner)
        assert N.fit_metrics(out, ["y"], "outcome").first().auc > 0.7
        assert out.filter(~F.col("yhat_y").between(0, 1)).count() == 0


def test_moderation_finds_a_slope_difference(spark):
    pdf = sample(4000, 8)
    pdf["res_y_purchase"] += 0.5 * pdf.res_T_int_fac * (pdf.H_level == 3)
    rows = E.moderation(spark.createDataFrame(pdf), ["res_y_purchase"], CUES).collect()
    got = {(r.treatment, r.test): r for r in rows}
    assert got[(CUES[2], "H3-H0")].estimate == pytest.approx(0.5, abs=0.15)
    # the other cues share part of the shifted one, so they move too, but far less
    assert got[(CUES[2], "omnibus")].p_value < 1e-10
    assert got[(CUES[2], "omnibus")].statistic > 5 * got[(CUES[1], "omnibus")].statistic


def test_families_of_several_sets_equal_one_family_each(spark):
    rng = np.random.default_rng(8)
    n = 1500
    pdf = pd.DataFrame({"user_id": rng.integers(0, 40, n).astype(str), "item_id": rng.integers(0, 30, n).astype(str), **{c: rng.normal(size=n) for c in "abc"}})
    pdf["res_y_purchase"] = 0.5 * pdf.a - 0.2 * pdf.c + rng.normal(size=n)
    pdf = pdf.rename(columns={"a": "res_T_con_mkt", "b": "res_T_con_soc", "c": "res_T_int_fac"})
    df, sets = spark.createDataFrame(pdf), {"all": ["res_T_con_mkt", "res_T_con_soc", "res_T_int_fac"], "few": ["res_T_con_mkt", "res_T_con_soc"]}
    together = E.families(df, ["res_y_purchase"], sets)
    for name, treatments in sets.items():
        one = E.family(df, ["res_y_purchase"], treatments).toPandas()
        pd.testing.assert_frame_equal(together[name].toPandas(), one, rtol=1e-9)
