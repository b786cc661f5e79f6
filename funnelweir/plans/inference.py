"""Queries: projections, effects, tests and resampling on residual tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelweir.operators import effects as E
from funnelweir.operators import moments as MO
from funnelweir.operators import multitest as MT
from funnelweir.operators import projection as PJ
from funnelweir.operators import resampling as RS
from funnelweir.operators import sensitivity as SE
from funnelweir.plans import oracle as Q
from funnelweir.plans import tables as B
from funnelweir.plans.registry import query, sql_rounded
from funnelweir.plans.residuals import ANALYTICAL, CUES, HEURISTIC, OUTCOMES, SQL, residuals
from funnelweir.session import stored

PLAIN = CUES[:3]
SHOWN = ["coefficient", "std_error", "z"]


def W(body: str, *ctes) -> str:  # noqa: N802
    parts = [SQL, *[c for group in ctes for c in ([group] if isinstance(group, str) else group)]]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"  # some of them walk in cycles


# ---- support gate ----------------------------------------------------------------


def support_ctes(p: str, source: str, columns, where: str = "TRUE") -> list[str]:
    long = " UNION ALL ".join(f"SELECT '{c}' AS treatment, {c} AS v FROM {source} WHERE {c} IS NOT NULL AND ({where})" for c in columns)
    return [
        f"{p}_l AS MATERIALIZED ({long})",
        f"""{p}_s AS (SELECT treatment, COUNT(*) AS support_n, STDDEV_SAMP(v) AS residual_sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS residual_iqr,
          quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS residual_width, MIN(v) AS lo, MAX(v) AS hi FROM {p}_l GROUP BY treatment)""",
        f"""{p}_h AS (SELECT treatment, LEAST(9, COALESCE(FLOOR(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) * 10 END), 0)) AS bin, COUNT(*) AS c, MAX(support_n) AS n
          FROM {p}_l JOIN {p}_s USING (treatment) GROUP BY 1, 2)""",
        f"""{p}_gate AS MATERIALIZED (SELECT s.treatment, support_n, residual_sd, residual_iqr, residual_width, effective_bins, min_bin_count, max_bin_share,
          support_n >= 500 AND residual_sd >= 0.02 AND residual_iqr >= 0.02 AND effective_bins >= 4 AS estimable,
          CASE WHEN support_n >= 500 AND residual_sd >= 0.02 AND residual_iqr >= 0.02 AND effective_bins >= 4 THEN 'ok' ELSE concat_ws('|',
          CASE WHEN support_n < 500 THEN 'small_n' END, CASE WHEN residual_sd < 0.02 THEN 'low_residual_sd' END,
          CASE WHEN residual_iqr < 0.02 THEN 'low_residual_iqr' END, CASE WHEN effective_bins < 4 THEN 'sparse_effective_bins' END) END AS support_flag
          FROM {p}_s s JOIN (SELECT treatment, COUNT(*) AS effective_bins, MIN(c) AS min_bin_count, MAX(c / n) AS max_bin_share FROM {p}_h GROUP BY 1) h USING (treatment))""",
    ]


THIN = """resid2 AS MATERIALIZED (SELECT *, CASE WHEN l_linenumber = 1 AND o_orderkey % 100 = 0 THEN res_T_con_mkt END AS res_rare,
  res_T_con_mkt / 10 AS res_flat, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS res_binary FROM resid)"""
THIN_COLUMNS = [*CUES, "res_rare", "res_flat", "res_binary"]


def thin(spark, d):
    """Residuals plus columns that fail the gate in different ways."""
    r = residuals(spark, d)
    rare = F.when((F.col("l_linenumber") == 1) & (F.col("o_orderkey") % 100 == 0), F.col("res_T_con_mkt"))
    binary = F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(0.0)
    return r.withColumns({"res_rare": rare, "res_flat": F.col("res_T_con_mkt") / 10, "res_binary": binary})


@query(
    "E1_histogram_stats",
    W(
        sql_rounded("SELECT treatment AS name, effective_bins, min_bin_count, max_bin_share FROM g_gate", ["name", "effective_bins", "min_bin_count"], ["max_bin_share"]),
        THIN,
        support_ctes("g", "resid2", THIN_COLUMNS),
    ),
)
def histogram_stats(spark, d):
    return E.histogram_stats(thin(spark, d), THIN_COLUMNS)


@query(
    "E2_support_gate",
    W(
        sql_rounded(
            "SELECT * FROM g_gate",
            ["treatment", "support_n", "effective_bins", "min_bin_count", "estimable", "support_flag"],
            ["residual_sd", "residual_iqr", "residual_width", "max_bin_share"],
        ),
        THIN,
        support_ctes("g", "resid2", THIN_COLUMNS),
    ),
)
def support_gate(spark, d):
    return E.support(thin(spark, d), THIN_COLUMNS)


# ---- least squares -----------------------------------------------------------------


def shown(df, *more):
    return df.select(*more, "treatment", *SHOWN, "n")


@query(
    "E3_two_way_clustered_ols",
    W(
        sql_rounded(Q.effect_rows("o", PLAIN), ["treatment", "n"], SHOWN),
        Q.ols_ctes("o", "resid", "res_y_purchase", PLAIN),
    ),
)
def two_way_ols(spark, d):
    return shown(E.weighted_effects(residuals(spark, d), ["res_y_purchase"], PLAIN))


@query(
    "E4_weighted_ols",
    W(
        sql_rounded(Q.effect_rows("o", PLAIN), ["treatment", "n"], SHOWN),
        Q.ols_ctes("o", "resid", "res_y_purchase", PLAIN, weight="1 + l_linenumber / 7.0"),
    ),
)
def weighted_ols(spark, d):
    weighted = residuals(spark, d).withColumn("w", 1 + F.col("l_linenumber") / 7.0)
    return shown(E.weighted_effects(weighted, ["res_y_purchase"], PLAIN, "w"))


@query(
    "E5_hc1_ols",
    W(
        sql_rounded(Q.effect_rows("o", PLAIN), ["treatment", "n"], SHOWN),
        Q.ols_ctes("o", "resid", "res_y_purchase", PLAIN, hc1=True),
    ),
)
def hc1_ols(spark, d):
    return shown(E.family(residuals(spark, d), ["res_y_purchase"], PLAIN, errors="hc1"))


def family_sql(levels, outcomes, treatments, source="resid") -> tuple[list[str], str]:
    ctes, rows = [], []
    for level in levels:
        for y in outcomes:
            p = f"o{level}_{y}"
            usable = [t for t in treatments if not (t == "res_T_int_sem" and level == "0")]
            where = "TRUE" if level == "ALL" else f"H_level = {level}"
            ctes += Q.ols_ctes(p, source, y, usable, where)
            rows.append(Q.effect_rows(p, usable, f"'{level}' AS h_level, '{y.replace('res_y_', '')}' AS stage, "))
    return ctes, " UNION ALL ".join(rows)


_E6_CTES, _E6_ROWS = family_sql(["ALL"], OUTCOMES, CUES)


@query(
    "E6_effect_family",
    W(sql_rounded(_E6_ROWS, ["h_level", "stage", "treatment", "n"], SHOWN), _E6_CTES),
)
def effect_family(spark, d):
    table = E.family(thin(spark, d), OUTCOMES, [*CUES, "res_flat"])
    return shown(table.filter("coefficient IS NOT NULL"), "h_level", "stage")


_E7_CTES, _E7_ROWS = family_sql(["ALL", "0", "1", "2", "3"], ["res_y_purchase"], CUES)


@query(
    "E7_effects_by_level",
    W(sql_rounded(_E7_ROWS, ["h_level", "stage", "treatment", "n"], SHOWN), _E7_CTES),
)
def effects_by_level(spark, d):
    table = E.family(residuals(spark, d), ["res_y_purchase"], CUES, by="H_level")
    return shown(table.filter("coefficient IS NOT NULL"), "h_level", "stage")


# ---- multiple testing ------------------------------------------------------------------

_P_SQL = "SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 10 > 0 THEN (c_custkey * 7919 % 100003) / 100003.0 END AS p FROM customer"


def p_values(spark, d):
    """One p-value per customer, families by nation and segment; some missing."""
    p = F.when(F.col("c_custkey") % 10 > 0, (F.col("c_custkey") * 7919 % 100003) / 100003.0)
    return B.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", p.alias("p"))


_RANKED_P = f"""r AS (SELECT *, COUNT(p) OVER (PARTITION BY c_nationkey, c_mktsegment) AS m,
  ROW_NUMBER() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY p NULLS LAST) AS k FROM ({_P_SQL}))"""


@query(
    "E8_holm",
    f"""WITH {_RANKED_P} SELECT c_custkey, CASE WHEN p IS NOT NULL THEN ROUND(MAX(LEAST(1, (m - k + 1) * p)) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY k), 6) + 0.0 END AS p_holm FROM r""",
)
def holm(spark, d):
    return MT.holm(p_values(spark, d), "p", ["c_nationkey", "c_mktsegment"]).select("c_custkey", "p_holm")


@query(
    "E9_benjamini_hochberg",
    f"""WITH {_RANKED_P} SELECT c_custkey, CASE WHEN p IS NOT NULL THEN ROUND(LEAST(1, MIN(m * p / k) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 END AS p_bh FROM r""",
)
def benjamini_hochberg(spark, d):
    return MT.benjamini_hochberg(p_values(spark, d), "p", ["c_nationkey", "c_mktsegment"]).select("c_custkey", "p_bh")


@query(
    "E10_pathway_holm",
    f"""WITH s AS (SELECT * FROM ({_P_SQL}) WHERE c_mktsegment = 'BUILDING'),
    r AS (SELECT *, COUNT(p) OVER (PARTITION BY c_nationkey) AS m, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY p NULLS LAST) AS k FROM s),
    h AS (SELECT c_custkey, CASE WHEN p IS NOT NULL THEN MAX(LEAST(1, (m - k + 1) * p)) OVER (PARTITION BY c_nationkey ORDER BY k) END AS v FROM r)
    SELECT c.c_custkey, ROUND(v, 6) + 0.0 AS p_pathway FROM customer c LEFT JOIN h USING (c_custkey)""",
)
def pathway_holm(spark, d):
    rows = MT.holm_within(p_values(spark, d), F.col("c_mktsegment") == "BUILDING", "p", ["c_nationkey"], "p_pathway")
    return rows.select("c_custkey", "p_pathway")


# ---- contrasts and joint tests ------------------------------------------------------------


def one_fit(spark, d, y="res_y_purchase", xs=PLAIN):
    r = residuals(spark, d)
    clean = E.numeric_columns(r, [y, *xs])
    fits = E.fit_designs(clean, [MO.Problem(y, tuple(xs), (y,))])
    return MO.cluster_errors(clean, fits, "user_id", "item_id")[0]


@query(
    "E11_linear_contrast",
    W(
        sql_rounded(
            """SELECT b1.v - b2.v AS estimate, sqrt(v11.v + v22.v - 2 * v12.v) AS std_error, (b1.v - b2.v) / sqrt(v11.v + v22.v - 2 * v12.v) AS z
            FROM o_b b1, o_b b2, o_v v11, o_v v22, o_v v12 WHERE b1.i = 1 AND b2.i = 2 AND v11.i = 1 AND v11.j = 1 AND v22.i = 2 AND v22.j = 2 AND v12.i = 1 AND v12.j = 2""",
            [],
            ["estimate", "std_error", "z"],
        ),
        Q.ols_ctes("o", "resid", "res_y_purchase", PLAIN),
    ),
)
def linear_contrast(spark, d):
    fit = one_fit(spark, d)
    estimate, error, z, _ = E.contrast(fit, {PLAIN[0]: 1.0, PLAIN[1]: -1.0})
    return E.small_frame(spark, [(estimate, error, z)], "estimate double, std_error double, z double")


@query(
    "E12_wald_test",
    W(
        """SELECT ROUND((b1.v * b1.v * v22.v - 2 * b1.v * b2.v * v12.v + b2.v * b2.v * v11.v) / (v11.v * v22.v - v12.v * v12.v), 6) + 0.0 AS statistic, 2 AS df,
        ROUND(exp(-0.5 * (b1.v * b1.v * v22.v - 2 * b1.v * b2.v * v12.v + b2.v * b2.v * v11.v) / (v11.v * v22.v - v12.v * v12.v)), 6) + 0.0 AS p_value
        FROM o_b b1, o_b b2, o_v v11, o_v v22, o_v v12 WHERE b1.i = 1 AND b2.i = 2 AND v11.i = 1 AND v11.j = 1 AND v22.i = 2 AND v22.j = 2 AND v12.i = 1 AND v12.j = 2""",
        Q.ols_ctes("o", "resid", "res_y_purchase", PLAIN),
    ),
)
def wald_test(spark, d):
    w = E.wald(one_fit(spark, d), PLAIN[:2])
    return E.small_frame(spark, [(w["statistic"], w["df"], w["p_value"])], "statistic double, df int, p_value double")


def moderation_sql(targets, semantic=None) -> tuple[list[str], str]:
    ctes, rows = [], []
    plain = [t for t in targets if t != semantic]
    at = lambda t, k: f"COALESCE({t}, 0) * (H_level = {k})::INT"
    levels = [f"(H_level = {k})::INT" for k in (1, 2, 3)]
    has = [f"({semantic} IS NOT NULL)::INT"] if semantic else []
    for t in targets:
        p = f"m_{t}"
        if t == semantic:
            own, reference, others = [at(t, k) for k in (1, 2, 3)], 1, (2, 3)
        else:
            own, reference, others = [at(t, k) for k in (1, 2, 3)], 0, (1, 2, 3)
        shared = [*plain, *has, *levels, *([f"COALESCE({semantic}, 0)"] if semantic and t != semantic else [])]
        xs = [*shared, *own]
        ctes += Q.ols_ctes(p, "resid", "res_y_purchase", xs)
        base = len(shared) + 1
        for k in others:
            i = base + k - 1
            if t == semantic:
                value, var = f"(b.v - c.v)", "(v.v + u.v - 2 * x.v)"
                rows.append(
                    f"SELECT '{t}' AS treatment, 'H{k}-H1' AS test, {value} AS estimate, sqrt({var}) AS std_error, n.n::BIGINT AS n FROM {p}_b b, {p}_b c, {p}_v v, {p}_v u, {p}_v x, {p}_n n "
                    f"WHERE b.i = {i} AND c.i = {base} AND v.i = {i} AND v.j = {i} AND u.i = {base} AND u.j = {base} AND x.i = {i} AND x.j = {base}"
                )
            else:
                rows.append(
                    f"SELECT '{t}' AS treatment, 'H{k}-H{reference}' AS test, b.v AS estimate, sqrt(v.v) AS std_error, n.n::BIGINT AS n FROM {p}_b b, {p}_v v, {p}_n n WHERE b.i = {i} AND v.i = {i} AND v.j = {i}"
                )
    return ctes, " UNION ALL ".join(rows)


_E13_CTES, _E13_ROWS = moderation_sql(PLAIN[:2])
_E14_CTES, _E14_ROWS = moderation_sql(["res_T_con_mkt", "res_T_int_sem"], "res_T_int_sem")


@query("E13_moderation", W(sql_rounded(_E13_ROWS, ["treatment", "test", "n"], ["estimate", "std_error"]), _E13_CTES))
def moderation(spark, d):
    table = E.moderation(residuals(spark, d), ["res_y_purchase"], PLAIN[:2])
    return table.filter("test <> 'omnibus'").select("treatment", "test", "estimate", "std_error", "n")


@query("E14_observed_level_moderation", W(sql_rounded(_E14_ROWS, ["treatment", "test", "n"], ["estimate", "std_error"]), _E14_CTES))
def observed_level_moderation(spark, d):
    table = E.moderation(
        residuals(spark, d), ["res_y_purchase"], ["res_T_con_mkt", "res_T_int_sem"], semantic="res_T_int_sem", observed_only=True
    )
    return table.filter("test <> 'omnibus'").select("treatment", "test", "estimate", "std_error", "n")


@query("E13_moderation_omnibus")
def moderation_omnibus(spark, d):
    return E.moderation(residuals(spark, d), OUTCOMES, CUES, semantic="res_T_int_sem")


_STAGES = {"click": "res_y_click", "cart": "res_y_cart", "purchase": "res_y_purchase"}
_E15 = {**_STAGES, "cart-click": "res_y_cart - res_y_click", "purchase-click": "res_y_purchase - res_y_click", "purchase-cart": "res_y_purchase - res_y_cart"}


@query(
    "E15_stage_contrasts",
    W(
        sql_rounded(
            " UNION ALL ".join(Q.effect_rows(f"s{i}", PLAIN, f"'{label}' AS stage, ") for i, label in enumerate(_E15)),
            ["stage", "treatment", "n"],
            SHOWN,
        ),
        *[Q.ols_ctes(f"s{i}", "resid", y, PLAIN) for i, y in enumerate(_E15.values())],
    ),
)
def stage_contrasts(spark, d):
    return shown(E.stage_contrasts(residuals(spark, d), _STAGES, PLAIN), "stage")


_E16_SQL = """t AS (SELECT p_brand AS component, s.stage, AVG((p_partkey * s.k % 13) - 6 + s.shift) / 10.0 AS coefficient,
  ((SUM(p_size) * s.k) % 19) / 100.0 AS p_holm, COUNT(*) % 7 > 0 AS estimable FROM part,
  (VALUES ('click', 7, 0.4), ('purchase', 11, -0.2), ('purchase-click', 5, 0.1)) s(stage, k, shift) GROUP BY p_brand, s.stage, s.k, s.shift)"""


@query(
    "E16_stage_patterns",
    f"""WITH {_E16_SQL}, w AS (SELECT component, {', '.join(f"MAX({c}) FILTER (WHERE stage = '{s}') AS {t}_{n}" for s, t in (('click', 'a'), ('purchase', 'b'), ('purchase-click', 'd')) for c, n in (('coefficient', 'c'), ('p_holm', 'p')))},
      BOOL_AND(estimable) AS ok FROM t GROUP BY component)
    SELECT component, CASE WHEN NOT ok THEN 'not_estimable_support_gate' WHEN a_c * b_c < 0 AND a_p < 0.05 AND b_p < 0.05 AND d_p < 0.05 THEN 'strict_reversal'
      WHEN a_c * b_c < 0 THEN 'suggestive_reversal' WHEN a_p >= 0.05 AND b_p < 0.05 AND d_p < 0.05 THEN 'purchase_stage_emergence'
      WHEN sign(a_c) = sign(b_c) AND d_p < 0.05 AND abs(b_c) < abs(a_c) THEN 'significant_attenuation'
      WHEN a_p >= 0.05 AND b_p >= 0.05 THEN 'no_reliable_endpoint_effect' ELSE 'stable_or_other_stage_pattern' END AS pattern FROM w""",
)
def stage_patterns(spark, d):
    stages = spark.createDataFrame([("click", 7, 0.4), ("purchase", 11, -0.2), ("purchase-click", 5, 0.1)], "stage string, k int, shift double")
    part = B.table(spark, d, "part").crossJoin(F.broadcast(stages))
    tests = part.groupBy(F.col("p_brand").alias("component"), "stage", "k").agg(
        (F.avg(F.col("p_partkey") * F.col("k") % 13 - 6 + F.col("shift")) / 10.0).alias("coefficient"),
        (F.sum("p_size") * F.col("k") % 19 / 100.0).alias("p_holm"),
        (F.count("*") % 7 > 0).alias("estimable"),
    )
    return E.stage_patterns(tests).select("component", "pattern")


@query("E17_joint_tests")
def joint_tests(spark, d):
    r = residuals(spark, d)
    gates = E.support_table(r, CUES)
    fits = E.family_fits(r, OUTCOMES, CUES, gates)
    table = E.small_frame(spark, E.joint_tests(fits, E.CUE_FAMILIES), E.JOINT_SCHEMA)
    table = MT.holm_within(table, F.col("test_scope") == "pathway", "p_value", ["h_level", "stage"], "p_pathway")
    return MT.benjamini_hochberg(table, "p_value", ["h_level", "stage"])


def effect_table(spark, d, treatments=PLAIN):
    return E.family(residuals(spark, d), ["res_y_purchase"], treatments)


_IQR_SQL = "iq AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS treatment, quantile_cont({t}, 0.75) - quantile_cont({t}, 0.25) AS iqr FROM resid" for t in PLAIN
) + ")"


@query(
    "E18_precision",
    W(
        sql_rounded(
            f"""SELECT treatment, 2.8015852181129683 * std_error AS mde, abs(coefficient) / (2.8015852181129683 * std_error) AS effect_to_mde,
            coefficient * iqr * 100 AS iqr_effect_pp FROM ({Q.effect_rows('o', PLAIN)}) JOIN iq USING (treatment)""",
            ["treatment"],
            ["mde", "effect_to_mde", "iqr_effect_pp"],
        ),
        _IQR_SQL,
        Q.ols_ctes("o", "resid", "res_y_purchase", PLAIN),
    ),
)
def precision(spark, d):
    return E.precision(effect_table(spark, d)).select("treatment", "mde", "effect_to_mde", "iqr_effect_pp")


@query(
    "E19_naive_and_residual_ols",
    W(
        sql_rounded(
            " UNION ALL ".join([Q.effect_rows("a", ["l_discount", "l_tax"], "'naive' AS estimator, "), Q.effect_rows("b", PLAIN[:2], "'residual' AS estimator, ")]),
            ["estimator", "treatment", "n"],
            SHOWN,
        ),
        """raw AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id, l_discount, l_tax, CAST(l_returnflag = 'N' AS INT) AS y_purchase
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
        Q.ols_ctes("a", "raw", "y_purchase", ["l_discount", "l_tax"]),
        Q.ols_ctes("b", "resid", "res_y_purchase", PLAIN[:2]),
    ),
)
def naive_and_residual(spark, d):
    line = B.table(spark, d, "lineitem")
    raw = line.join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("item_id"), "l_discount", "l_tax",
        (F.col("l_returnflag") == "N").cast("int").alias("y_purchase"),
    )
    a = E.weighted_effects(raw, ["y_purchase"], ["l_discount", "l_tax"]).withColumn("estimator", F.lit("naive"))
    b = E.weighted_effects(residuals(spark, d), ["res_y_purchase"], PLAIN[:2]).withColumn("estimator", F.lit("residual"))
    return shown(a.unionByName(b), "estimator")


_GPS_SQL = """g0 AS (SELECT *, res_T_int_fac AS t, 0.8 * res_T_con_mkt AS hat FROM resid), gs AS (SELECT AVG(t) AS m, STDDEV_SAMP(t) AS s FROM g0),
g1 AS (SELECT g0.*, exp(LEAST(20, GREATEST(-20, -0.5 * pow((t - m) / s, 2) - ln(s) + 0.5 * pow((t - hat) / 0.3, 2) + ln(0.3)))) AS raw_w FROM g0, gs),
cap AS (SELECT quantile_cont(raw_w, 0.995) AS c FROM g1), g2 AS MATERIALIZED (SELECT g1.*, LEAST(raw_w, c) / AVG(LEAST(raw_w, c)) OVER () AS gw FROM g1, cap)"""


def gps(spark, d):
    r = residuals(spark, d).withColumns({"t": F.col("res_T_int_fac"), "hat": 0.8 * F.col("res_T_con_mkt")})
    return E.stabilized_weights(r, "t", "hat", 0.3, 0.995, "gw")


@query(
    "E20_stabilized_weights",
    W(
        sql_rounded(
            """SELECT AVG(gw) AS weight_mean, MAX(gw) AS weight_max, SUM(gw) * SUM(gw) / SUM(gw * gw) AS effective_sample_size, quantile_cont(gw, 0.99) AS weight_p99 FROM g2""",
            [],
            ["weight_mean", "weight_max", "effective_sample_size", "weight_p99"],
            4,
        ),
        _GPS_SQL,
    ),
)
def stabilized_weights(spark, d):
    return E.weight_summary(gps(spark, d), "gw").select(*[F.round(c, 4).alias(c) for c in ("weight_mean", "weight_max", "effective_sample_size", "weight_p99")])


@query(
    "E20_weighted_effect",
    W(sql_rounded(Q.effect_rows("o", ["t"]), ["treatment", "n"], SHOWN), _GPS_SQL, Q.ols_ctes("o", "g2", "res_y_purchase", ["t"], weight="gw")),
)
def gps_effect(spark, d):
    return shown(E.weighted_effects(gps(spark, d), ["res_y_purchase"], ["t"], "gw"))


@query(
    "J10_specification_comparison",
    W(
        sql_rounded(
            f"""SELECT a.treatment, a.coefficient AS coefficient_primary, b.coefficient AS coefficient_full, b.coefficient - a.coefficient AS coefficient_change,
            abs(b.coefficient - a.coefficient) / abs(a.coefficient) AS relative_change, sign(a.coefficient) = sign(b.coefficient) AS sign_stable, a.n AS n_primary, b.n AS n_full
            FROM ({Q.effect_rows('a', CUES)}) a JOIN ({Q.effect_rows('b', PLAIN)}) b USING (treatment)""",
            ["treatment", "sign_stable", "n_primary", "n_full"],
            ["coefficient_primary", "coefficient_full", "coefficient_change", "relative_change"],
        ),
        Q.ols_ctes("a", "resid", "res_y_purchase", CUES),
        Q.ols_ctes("b", "resid", "res_y_purchase", PLAIN),
    ),
)
def specification_comparison(spark, d):
    full, reduced = (MT.holm(effect_table(spark, d, t), "p_value", ["stage"]) for t in (CUES, PLAIN))
    return E.specification_comparison(full, reduced, ["treatment"]).drop("p_holm_primary", "p_holm_full", "significance_stable")


@query("E21_specification_sensitivity")
def specification_sensitivity(spark, d):
    tables = E.families(residuals(spark, d), OUTCOMES, {"full": CUES, "reduced": PLAIN})
    full, reduced = (MT.holm(tables[k], "p_value", ["stage"]) for k in ("full", "reduced"))
    return E.specification_comparison(full, reduced, ["stage", "treatment"])


@query(
    "E24_support_consistent",
    W(
        """SELECT treatment, estimable, CASE WHEN estimable THEN 'keep' ELSE 'exclude' END AS decision, CASE WHEN estimable THEN 'support gate passed' ELSE support_flag END AS reason FROM g_gate""",
        THIN,
        support_ctes("g", "resid2", THIN_COLUMNS),
    ),
)
def support_consistent(spark, d):
    r = thin(spark, d)
    results = E.weighted_effects(r, ["res_y_purchase"], ["res_flat"]).select("treatment").unionByName(
        spark.createDataFrame([(c,) for c in THIN_COLUMNS if c != "res_flat"], "treatment string")
    )
    return E.support_consistent(results, E.support(r, THIN_COLUMNS)).select("treatment", "estimable", "decision", "reason")


@query(
    "E25_iqr_effects",
    W(
        sql_rounded(
            f"""SELECT treatment, coefficient * iqr * 100 AS iqr_effect_pp, (coefficient - 1.96 * std_error) * iqr * 100 AS iqr_ci_lower_pp,
            n = (SELECT COUNT(*) FROM resid) AS n_match FROM ({Q.effect_rows('o', PLAIN)}) JOIN iq USING (treatment)""",
            ["treatment", "n_match"],
            ["iqr_effect_pp", "iqr_ci_lower_pp"],
        ),
        _IQR_SQL,
        Q.ols_ctes("o", "resid", "res_y_purchase", PLAIN),
    ),
)
def iqr_effects(spark, d):
    r = residuals(spark, d)
    return E.iqr_effects(r, PLAIN, E.family(r, ["res_y_purchase"], PLAIN)).select("treatment", "iqr_effect_pp", "iqr_ci_lower_pp", "n_match")


@query(
    "E26_robustness_value",
    W(
        sql_rounded(
            f"""SELECT treatment, 0.5 * (sqrt(f2 * f2 + 4 * f2) - f2) AS robustness_value FROM (SELECT treatment, z * z / (n - 1) AS f2 FROM ({Q.effect_rows('o', PLAIN)}))""",
            ["treatment"],
            ["robustness_value"],
        ),
        Q.ols_ctes("o", "resid", "res_y_purchase", PLAIN),
    ),
)
def robustness_value(spark, d):
    return E.robustness_value(effect_table(spark, d)).select("treatment", "robustness_value")


# ---- projections --------------------------------------------------------------------------


def projection_sql(p, targets, controls, fill=True, quadratic=False, suffix="__gs_pure"):
    x = [f"COALESCE({c}, 0)" for c in controls] if fill else list(controls)
    xs = list(x)
    if quadratic:
        xs += [f"{c} * {c}" for c in x] + [f"{a} * {b}" for i, a in enumerate(x) for b in x[i + 1 :]]
    where = "split = 'B'" + ("" if fill else " AND " + " AND ".join(f"{c} IS NOT NULL" for c in controls))
    ctes = [c for i, t in enumerate(targets) for c in Q.ols_ctes(f"{p}{i}", "resid", t, xs, where, clusters=False)]
    applied = [f"COALESCE({c}, 0)" for c in controls]
    applied_xs = list(applied)
    if quadratic:
        applied_xs += [f"{c} * {c}" for c in applied] + [f"{a} * {b}" for i, a in enumerate(applied) for b in applied[i + 1 :]]
    terms = [
        f"{t} - ({' + '.join([f'{p}{i}_w.c0', *[f'{p}{i}_w.c{j} * {x}' for j, x in enumerate(applied_xs, 1)]])}) AS \"{t}{suffix}\""
        for i, t in enumerate(targets)
    ]
    tables = ", ".join(f"{p}{i}_w" for i in range(len(targets)))
    return ctes, f"SELECT o_orderkey, l_linenumber, item_id, {', '.join(terms)} FROM resid, {tables} WHERE split = 'C'"


KEY = ["o_orderkey", "l_linenumber", "item_id"]
_M7 = projection_sql("p", ANALYTICAL, HEURISTIC)
_M6 = projection_sql("p", ANALYTICAL[:1], HEURISTIC, quadratic=True)
_M8 = projection_sql("p", HEURISTIC, ANALYTICAL, suffix="__reverse_gs_pure")
_M10 = projection_sql("p", HEURISTIC[:1], ["res_T_int_sem"], fill=False)


def halves(spark, d):
    r = residuals(spark, d)
    return r.filter("split = 'B'"), r.filter("split = 'C'")


@query("M7_pathway_projection", W(sql_rounded(_M7[1], KEY, [f"{t}__gs_pure" for t in ANALYTICAL]), _M7[0]))
def pathway_projection(spark, d):
    out, _, _, _ = PJ.fit_apply(*halves(spark, d), HEURISTIC, ANALYTICAL)
    return out.select(*KEY, *[f"{t}__gs_pure" for t in ANALYTICAL])


@query("M6_quadratic_projection", W(sql_rounded(_M6[1], KEY, ["res_T_int_fac__gs_pure"]), _M6[0]))
def quadratic_projection(spark, d):
    out, _, _, _ = PJ.fit_apply(*halves(spark, d), HEURISTIC, ANALYTICAL[:1], "linear_quadratic")
    return out.select(*KEY, "res_T_int_fac__gs_pure")


@query("M8_reverse_projection", W(sql_rounded(_M8[1], KEY, [f"{t}__reverse_gs_pure" for t in HEURISTIC]), _M8[0]))
def reverse_projection(spark, d):
    out, _, _, _ = PJ.reverse_fit_apply(*halves(spark, d), HEURISTIC, ANALYTICAL)
    return out.select(*KEY, *[f"{t}__reverse_gs_pure" for t in HEURISTIC])


@query(
    "M9_frozen_projection",
    W(sql_rounded('SELECT o_orderkey, l_linenumber, item_id, res_T_int_fac - (0.01 + 0.5 * res_T_con_mkt - 0.25 * res_T_con_soc) AS "res_T_int_fac__gs_pure" FROM resid', KEY, ["res_T_int_fac__gs_pure"])),
)
def frozen_projection(spark, d):
    parameters = {"const": 0.01, "_d_res_T_con_mkt": 0.5, "_d_res_T_con_soc": -0.25}
    manifest = {"res_T_int_fac": {"train_n": 1, "r2": None, "design": list(parameters), "parameters": parameters}}
    out, _ = PJ.apply_projection(residuals(spark, d), HEURISTIC, manifest)
    return out.select(*KEY, "res_T_int_fac__gs_pure")


@query("M10_taxonomy_projection", W(sql_rounded(_M10[1], KEY, ["res_T_con_mkt__gs_pure"]), _M10[0]))
def taxonomy_projection(spark, d):
    train, final = halves(spark, d)
    fitted = PJ.fit_projection(train, ["res_T_int_sem"], HEURISTIC[:1], fill_controls=False)
    out, _ = PJ.apply_projection(final, ["res_T_int_sem"], fitted)
    return out.select(*KEY, "res_T_con_mkt__gs_pure")


@query(
    "M7_projection_diagnostics",
    W(
        sql_rounded(
            " UNION ALL ".join(
                f"SELECT '{t}' AS target, COUNT(*) AS train_n, 1 - SUM(e * e) / (SUM(y * y) - SUM(y) * SUM(y) / COUNT(*)) AS projection_r2, 'fitted_on_A_to_B_residuals' AS status FROM p{i}_e"
                for i, t in enumerate(ANALYTICAL)
            ),
            ["target", "train_n", "status"],
            ["projection_r2"],
        ),
        _M7[0],
    ),
)
def projection_diagnostics(spark, d):
    return PJ.fit_apply(*halves(spark, d), HEURISTIC, ANALYTICAL)[2]


@query(
    "M11_mediator_residual",
    W(
        sql_rounded(
            "SELECT o_orderkey, l_linenumber, item_id, res_T_con_soc - (c0 + c1 * res_T_con_mkt + c2 * res_T_int_fac) AS m_tilde FROM resid, o_w", KEY, ["m_tilde"]
        ),
        Q.ols_ctes("o", "resid", "res_T_con_soc", ["res_T_con_mkt", "res_T_int_fac"], clusters=False),
    ),
)
def mediator_residual(spark, d):
    out = RS.mediator_residual(residuals(spark, d), "res_T_con_soc", ["res_T_con_mkt", "res_T_int_fac"], "m_tilde")
    return out.select(*KEY, "m_tilde")


@query("E22_projection_order")
def projection_order(spark, d):
    r = stored(residuals(spark, d).select("user_id", "item_id", "split", *OUTCOMES, *CUES))
    train, final = r.filter("split = 'B'"), r.filter("split = 'C'")
    # purified columns have names of their own, so the variants share one frame
    frame, standard = PJ.fit_apply(train, final, HEURISTIC, ANALYTICAL)[:2]
    frame, reverse = PJ.reverse_fit_apply(train, frame, HEURISTIC, ANALYTICAL)[:2]
    variants = {"standard_heuristic_to_analytical": standard, "no_gs": CUES, "reverse_analytical_to_heuristic": reverse}
    out = None
    for name, table in E.families(frame, OUTCOMES, variants).items():
        table = table.withColumn("variant", F.lit(name))
        out = table if out is None else out.unionByName(table)
    return MT.holm(out, "p_value", ["variant", "stage"])


# ---- resampling ------------------------------------------------------------------------------

REPS, PATH_REPS = 200, 500
_MOMENTS = ["n", "sx", "sxx", "sy", "sxy", "sm", "smm", "sxm", "smy"]
_CLUSTERS = """cl AS MATERIALIZED (SELECT user_id, COUNT(*)::DOUBLE AS n, SUM(res_T_con_soc) AS sx, SUM(res_T_con_soc * res_T_con_soc) AS sxx, SUM(res_y_purchase) AS sy,
  SUM(res_T_con_soc * res_y_purchase) AS sxy, SUM(res_T_int_fac) AS sm, SUM(res_T_int_fac * res_T_int_fac) AS smm, SUM(res_T_con_soc * res_T_int_fac) AS sxm,
  SUM(res_T_int_fac * res_y_purchase) AS smy FROM resid GROUP BY user_id)"""


def _boot_sql(reps: int) -> list[str]:
    sums = ", ".join(f"SUM(times * {c}) AS {c}" for c in _MOMENTS)
    return [_CLUSTERS, *Q.bootstrap_ctes("drawn", "cl", "user_id", reps, 11), f"boot AS MATERIALIZED (SELECT rep, {sums} FROM drawn GROUP BY rep)"]


@query(
    "R10_cluster_bootstrap",
    W(
        sql_rounded(
            f"""SELECT 'res_T_con_soc' AS treatment, COUNT(*) AS successes, quantile_cont(b, 0.025) AS boot_lower, quantile_cont(b, 0.975) AS boot_upper
            FROM (SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM boot)""",
            ["treatment", "successes"],
            ["boot_lower", "boot_upper"],
        ),
        _boot_sql(REPS),
    ),
)
def cluster_bootstrap(spark, d):
    return RS.bootstrap_interval(residuals(spark, d), "res_y_purchase", ["res_T_con_soc"], REPS, 11)


_PATH_SQL = """SELECT rep, (sxm - sx * sm / n) / (sxx - sx * sx / n) AS a, ((smy - sm * sy / n) * (sxx - sx * sx / n) - (sxy - sx * sy / n) * (sxm - sx * sm / n))
  / ((smm - sm * sm / n) * (sxx - sx * sx / n) - pow(sxm - sx * sm / n, 2)) AS b, n FROM {t}"""


@query(
    "R12_indirect_effects",
    W(
        sql_rounded(
            """SELECT 'res_T_con_soc' AS treatment, p.a AS path_a, p.b AS path_b, p.a * p.b AS indirect, lo AS ci_lower, hi AS ci_upper, raw AS p_value_raw,
            LEAST(1, 2 * (round_even(raw * reps / 2, 0) + 1) / (reps + 1)) AS p_value, p.n::BIGINT AS n FROM p, q""",
            ["treatment", "n"],
            ["path_a", "path_b", "indirect", "ci_lower", "ci_upper", "p_value_raw", "p_value"],
        ),
        _boot_sql(PATH_REPS),
        "tot AS (SELECT 0 AS rep, SUM(n) AS n, SUM(sx) AS sx, SUM(sxx) AS sxx, SUM(sy) AS sy, SUM(sxy) AS sxy, SUM(sm) AS sm, SUM(smm) AS smm, SUM(sxm) AS sxm, SUM(smy) AS smy FROM cl)",
        f"p AS ({_PATH_SQL.format(t='tot')})",
        f"bp AS ({_PATH_SQL.format(t='boot')})",
        "q AS (SELECT quantile_cont(a * b, 0.025) AS lo, quantile_cont(a * b, 0.975) AS hi, COUNT(*) AS reps, LEAST(1, 2 * LEAST(AVG((a * b >= 0)::INT), AVG((a * b <= 0)::INT))) AS raw FROM bp)",
    ),
)
def indirect_effects(spark, d):
    table = RS.indirect_effects(residuals(spark, d), ["res_T_con_soc"], "res_T_int_fac", ["res_y_purchase"], PATH_REPS, 11)
    return table.select("treatment", "path_a", "path_b", "indirect", "ci_lower", "ci_upper", "p_value_raw", "p_value", "n")


@query("E28_channel_table")
def channel_table(spark, d):
    r = RS.mediator_residual(residuals(spark, d), "res_T_con_soc", ["res_T_con_mkt"], "m_tilde")
    return RS.indirect_effects(r, ["res_T_con_mkt", "res_T_int_fac"], "m_tilde", OUTCOMES, PATH_REPS, 12)


PERM_SEED = 31
PERMUTATIONS = 200
_PERM_SQL = f"""tot AS (SELECT COUNT(*) AS n, SUM(res_T_con_soc) AS sx, SUM(res_T_con_soc * res_T_con_soc) AS sxx, SUM(res_y_purchase) AS sy FROM resid),
ord AS MATERIALIZED (SELECT ROW_NUMBER() OVER (ORDER BY o_orderkey, l_linenumber, item_id, res_T_int_fac::DECIMAL(18,6)::VARCHAR) - 1 AS pos, res_T_con_soc AS x, res_y_purchase AS y FROM resid),
src AS MATERIALIZED (SELECT r.rep, pos, 0::BIGINT AS start, n::BIGINT AS n FROM ord, tot, range(1, {PERMUTATIONS + 1}) r(rep)),
{", ".join(Q.permuted_ctes("pm", "src", PERM_SEED))},
draw AS (SELECT rep, SUM(a.x * b.y) AS sxy FROM pm JOIN ord a ON pm.pos = a.pos JOIN ord b ON pm.v = b.pos GROUP BY rep),
perm AS MATERIALIZED (SELECT rep, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS coefficient FROM draw, tot)"""


def permuted(spark, d):
    r = residuals(spark, d).withColumn("k", F.col("res_T_int_fac").cast("decimal(18,6)").cast("string"))
    key = ["o_orderkey", "l_linenumber", "item_id", "k"]
    return RS.permutation_coefficients(r, ["res_y_purchase"], ["res_T_con_soc"], key, PERMUTATIONS, PERM_SEED)


@query("R13_permutation", W(sql_rounded("SELECT rep::INT AS rep, coefficient FROM perm", ["rep"], ["coefficient"]), _PERM_SQL))
def permutation(spark, d):
    return permuted(spark, d).select("rep", "coefficient")


@query(
    "E27_placebo_table",
    W(
        sql_rounded(
            """SELECT 'res_T_con_soc' AS treatment, b.v AS coefficient, AVG(coefficient) AS placebo_mean, STDDEV_SAMP(coefficient) AS placebo_sd, quantile_cont(coefficient, 0.025) AS placebo_lower,
            quantile_cont(coefficient, 0.975) AS placebo_upper, (1 + COUNT(*) FILTER (WHERE abs(coefficient) >= abs(b.v))) / (COUNT(*) + 1.0) AS placebo_p, COUNT(*) AS placebo_reps
            FROM perm, o_b b WHERE b.i = 1 GROUP BY b.v""",
            ["treatment", "placebo_reps"],
            ["coefficient", "placebo_mean", "placebo_sd", "placebo_lower", "placebo_upper", "placebo_p"],
        ),
        _PERM_SQL,
        Q.ols_ctes("o", "resid", "res_y_purchase", ["res_T_con_soc"], clusters=False),
    ),
)
def placebo_table(spark, d):
    actual = E.weighted_effects(residuals(spark, d), ["res_y_purchase"], ["res_T_con_soc"]).select("stage", "treatment", "coefficient")
    return RS.placebo_table(permuted(spark, d), actual).drop("stage")


# ---- omitted confounding -----------------------------------------------------------------------

_ELEMENTS = """SELECT '{t}' AS treatment, b.v AS theta, (SELECT SUM(e * e) / COUNT(*) FROM {p}_e) AS sigma2, n.n * v.v AS nu2, n.n::BIGINT AS n
  FROM {p}_b b, {p}_inv v, {p}_n n WHERE b.i = {i} AND v.i = {i} AND v.j = {i}"""


def elements_sql(p, treatments):
    return " UNION ALL ".join(_ELEMENTS.format(p=p, t=t, i=i) for i, t in enumerate(treatments, 1))


@query(
    "E29_sensitivity_elements",
    W(sql_rounded(elements_sql("o", PLAIN), ["treatment", "n"], ["theta", "sigma2", "nu2"]), Q.ols_ctes("o", "resid", "res_y_purchase", PLAIN, clusters=False)),
)
def sensitivity_elements(spark, d):
    found = SE.elements(residuals(spark, d), ["res_y_purchase"], PLAIN)
    rows = [(t, e["theta"], e["sigma2"], e["nu2"], e["n"]) for (_, t), e in found.items()]
    return E.small_frame(spark, rows, "treatment string, theta double, sigma2 double, nu2 double, n long")


def short_frame(spark, d):
    """The same columns as if one covariate had been left out of the nuisance fits."""
    r = residuals(spark, d)
    return r.withColumns(
        {
            "res_y_purchase": F.col("res_y_purchase") + 0.05 * F.col("res_T_int_fac"),
            **{t: F.col(t) * 1.1 + 0.02 * (F.col("l_linenumber") - 4) for t in PLAIN},
        }
    )


@query(
    "E29_benchmark_gains",
    W(
        sql_rounded(
            f"""SELECT l.treatment, s.theta - l.theta AS delta_theta, LEAST(1, GREATEST(0, (s.sigma2 - l.sigma2) / l.sigma2)) AS cf_y,
            LEAST(1, GREATEST(0, (1 - s.nu2 / l.nu2) / (s.nu2 / l.nu2))) AS cf_d FROM ({elements_sql('o', PLAIN)}) l JOIN ({elements_sql('q', PLAIN)}) s USING (treatment)""",
            ["treatment"],
            ["delta_theta", "cf_y", "cf_d"],
        ),
        "short AS (SELECT user_id, item_id, res_y_purchase + 0.05 * res_T_int_fac AS res_y_purchase, "
        + ", ".join(f"{t} * 1.1 + 0.02 * (l_linenumber - 4) AS {t}" for t in PLAIN)
        + " FROM resid)",
        Q.ols_ctes("o", "resid", "res_y_purchase", PLAIN, clusters=False),
        Q.ols_ctes("q", "short", "res_y_purchase", PLAIN, clusters=False),
    ),
)
def benchmark_gains(spark, d):
    gains, _ = SE.bounds(residuals(spark, d), {"user_history": short_frame(spark, d)}, ["res_y_purchase"], PLAIN, reps=1000)
    return gains.select(F.concat(F.lit("res_"), "treatment").alias("treatment"), "delta_theta", "cf_y", "cf_d")


@query("R11_wild_bounds")
def wild_bounds(spark, d):
    _, bounds = SE.bounds(residuals(spark, d), {"user_history": short_frame(spark, d)}, ["res_y_purchase"], PLAIN, reps=1000)
    return SE.classify_bounds(bounds)


_BOUND_TABLE = """bt AS (SELECT p_brand AS treatment, 'purchase' AS stage, 'price' AS benchmark, m AS multiplier, CASE WHEN s % 3 = 0 AND m > 0 THEN 1.0 ELSE m * 0.1 END AS cf_d,
  CASE WHEN s % 2 = 0 THEN 0.0 ELSE m * 0.05 END AS cf_y, (s % 11 - 5) / 10.0 AS theta, (s % 11 - 5) / 10.0 * (1 - m * 0.4) AS adjusted, 0.2 AS point_value, 0.1 AS interval_value
  FROM (SELECT p_brand, SUM(p_size) AS s FROM part GROUP BY p_brand), range(0, 4) t(m))"""


def bound_table(spark, d):
    brands = B.table(spark, d, "part").groupBy(F.col("p_brand").alias("treatment")).agg(F.sum("p_size").alias("s"))
    t = brands.withColumn("multiplier", F.explode(F.sequence(F.lit(0), F.lit(3))))
    theta = (F.col("s") % 11 - 5) / 10.0
    m = F.col("multiplier")
    adjusted = theta * (1 - m * 0.4)
    return t.select(
        "treatment", F.lit("purchase").alias("stage"), F.lit("price").alias("benchmark"), "multiplier",
        F.when((F.col("s") % 3 == 0) & (m > 0), 1.0).otherwise(m * 0.1).alias("cf_d"),
        F.when(F.col("s") % 2 == 0, 0.0).otherwise(m * 0.05).alias("cf_y"),
        theta.alias("theta"), adjusted.alias("adjusted"), (adjusted - 0.05).alias("adjusted_lower"), (adjusted + 0.05).alias("adjusted_upper"),
        F.lit(0.2).alias("point_value"), F.lit(0.1).alias("interval_value"),
    )


_BOUND_CLASS = """bc AS (SELECT *, CASE WHEN multiplier = 0 THEN 'REFERENCE' WHEN cf_d >= 1 - 1e-8 AND cf_y <= 1e-12 THEN 'NONINFORMATIVE_ZERO_OUTCOME_GAIN'
  WHEN cf_d >= 1 - 1e-8 THEN 'UNBOUNDED_CF_D_BOUNDARY' ELSE 'FINITE' END AS bound_status FROM bt),
bd AS (SELECT *, CASE WHEN bound_status IN ('FINITE', 'REFERENCE') THEN adjusted END AS shown, CASE WHEN bound_status = 'REFERENCE' THEN 'UNADJUSTED_REFERENCE'
  WHEN bound_status = 'NONINFORMATIVE_ZERO_OUTCOME_GAIN' THEN 'BENCHMARK_NOT_INFORMATIVE_FOR_BIAS_BOUND' WHEN bound_status = 'UNBOUNDED_CF_D_BOUNDARY' THEN 'ADVERSARIAL_BOUND_NOT_FINITE'
  WHEN theta <> 0 AND sign(theta) = sign(adjusted) THEN 'POINT_DIRECTION_PRESERVED' ELSE 'FINITE_BOUND_CROSSES_ZERO' END AS conclusion FROM bc)"""


@query(
    "E30_bound_status",
    f"WITH {_BOUND_TABLE}, {_BOUND_CLASS} " + sql_rounded("SELECT treatment, multiplier::INT AS multiplier, bound_status, conclusion, shown AS bounded_adjusted FROM bd", ["treatment", "multiplier", "bound_status", "conclusion"], ["bounded_adjusted"]),
)
def bound_status(spark, d):
    return SE.classify_bounds(bound_table(spark, d)).select("treatment", "multiplier", "bound_status", "conclusion", "bounded_adjusted")


@query(
    "E30_focal_summary",
    f"WITH {_BOUND_TABLE}, {_BOUND_CLASS} "
    + sql_rounded(
        """SELECT treatment, MAX(theta) AS theta, 20.0 AS point_percent, 10.0 AS interval_percent, MAX(shown) FILTER (WHERE multiplier = 1) AS adjusted_at_1x, MAX(shown) FILTER (WHERE multiplier = 2) AS adjusted_at_2x,
        MAX(shown) FILTER (WHERE multiplier = 3) AS adjusted_at_3x, MAX(conclusion) FILTER (WHERE multiplier = 3) AS conclusion_at_3x FROM bd WHERE treatment IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY treatment""",
        ["treatment", "conclusion_at_3x"],
        ["theta", "point_percent", "interval_percent", "adjusted_at_1x", "adjusted_at_2x", "adjusted_at_3x"],
    ),
)
def focal_summary(spark, d):
    focal = [("purchase", f"Brand#{k}") for k in (1, 2, 3)]
    table = SE.focal_summary(SE.classify_bounds(bound_table(spark, d)), focal)
    return table.select("treatment", "theta", "point_percent", "interval_percent", "adjusted_at_1x", "adjusted_at_2x", "adjusted_at_3x", "conclusion_at_3x")
