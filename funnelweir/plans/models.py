"""Queries: nuisance models, certification and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelweir.operators import certify as C
from funnelweir.operators import diagnostics as DG
from funnelweir.operators import effects as E
from funnelweir.operators import nuisance as N
from funnelweir.operators import projection as PJ
from funnelweir.operators import quality as QU
from funnelweir.operators import splits as SP
from funnelweir.plans import oracle as Q
from funnelweir.plans import tables as B
from funnelweir.plans.features import SPLIT_SQL, long_measures_sql, split_funnel
from funnelweir.plans.inference import THIN, THIN_COLUMNS, support_ctes, thin
from funnelweir.plans.inference import W as WR
from funnelweir.plans import master as M
from funnelweir.plans.flagship import certified_splits
from funnelweir.plans.master import calibrate
from funnelweir.plans.registry import query, sql_rounded
from funnelweir.plans.residuals import ANALYTICAL, HEURISTIC, residuals
from funnelweir.session import cut

W = B.sql_with
X = ["x_size", "x_price", "x_gap"]
TREATMENTS = ["T_a", "T_b"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey"]

NUIS_SQL = """nuis AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 'B' ELSE 'C' END AS split,
  l_discount * 10 AS T_a, CASE WHEN l_linenumber % 5 > 0 THEN l_tax * 12 END AS T_b, CAST(l_returnflag = 'N' AS INT) AS y_purchase,
  l_quantity / 50 AS x_size, ln(1 + l_extendedprice) - 10 AS x_price, CASE WHEN l_linenumber % 3 > 0 THEN l_discount + l_tax END AS x_gap FROM lineitem)"""
FILLED = [f"COALESCE({x}, 0)" for x in X]
SPLIT_B = "split = 'B'"


def nuisance_table(spark, d):
    line = B.table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    return line.select(
        *KEY,
        F.when(F.col("l_suppkey") % 2 == 0, "B").otherwise("C").alias("split"),
        (F.col("l_discount") * 10).alias("T_a"),
        F.when(n % 5 > 0, F.col("l_tax") * 12).alias("T_b"),
        (F.col("l_returnflag") == "N").cast("int").alias("y_purchase"),
        (F.col("l_quantity") / 50).alias("x_size"),
        (F.log1p("l_extendedprice") - 10).alias("x_price"),
        F.when(n % 3 > 0, F.col("l_discount") + F.col("l_tax")).alias("x_gap"),
    )


def parts(spark, d):
    t = nuisance_table(spark, d)
    return t.filter("split = 'B'"), t.filter("split = 'C'")


def fitted(p: str) -> str:
    return " + ".join([f"{p}_w.c0", *[f"{p}_w.c{i} * {x}" for i, x in enumerate(FILLED, 1)]])


def clipped(p: str) -> str:
    return f"LEAST(1, GREATEST(0, {fitted(p)}))"


_FITS = {t: Q.ols_ctes(f"f_{t}", "nuis", t, FILLED, "split = 'B'", clusters=False) for t in [*TREATMENTS, "y_purchase"]}
_RES = f"""nres AS MATERIALIZED (SELECT nuis.*, {', '.join(f"{t} AS raw_{t}, CASE WHEN {t} IS NOT NULL THEN {clipped(f'f_{t}')} END AS mhat_{t}" for t in TREATMENTS)},
  y_purchase AS raw_y_purchase, {clipped('f_y_purchase')} AS yhat_y_purchase FROM nuis, {', '.join(f'f_{t}_w' for t in [*TREATMENTS, 'y_purchase'])} WHERE split = 'C')"""


def WN(body: str, *more: str) -> str:  # noqa: N802
    ctes = [NUIS_SQL, *[c for f in _FITS.values() for c in f], _RES, *more]
    return f"WITH {', '.join(ctes)} {body}"


def treatment_fit(spark, d):
    return N.residualize(*parts(spark, d), TREATMENTS, X)


def outcome_fit(spark, d):
    return N.residualize(*parts(spark, d), ["y_purchase"], X, "outcome")


@query(
    "M1_treatment_residuals",
    WN(
        sql_rounded(
            f"SELECT {', '.join(KEY)}, {', '.join(f'raw_{t}, mhat_{t}, raw_{t} - mhat_{t} AS res_{t}' for t in TREATMENTS)} FROM nres",
            KEY,
            [f"{k}_{t}" for t in TREATMENTS for k in ("raw", "mhat", "res")],
            5,
        )
    ),
)
def treatment_residuals(spark, d):
    out = treatment_fit(spark, d)
    return out.select(*KEY, *[F.round(f"{k}_{t}", 5).alias(f"{k}_{t}") for t in TREATMENTS for k in ("raw", "mhat", "res")])


@query(
    "M2_outcome_residuals",
    WN(
        sql_rounded(
            f"SELECT {', '.join(KEY)}, raw_y_purchase, yhat_y_purchase, raw_y_purchase - yhat_y_purchase AS res_y_purchase FROM nres",
            KEY,
            ["raw_y_purchase", "yhat_y_purchase", "res_y_purchase"],
            5,
        )
    ),
)
def outcome_residuals(spark, d):
    out = outcome_fit(spark, d)
    return out.select(*KEY, *[F.round(f"{k}_y_purchase", 5).alias(f"{k}_y_purchase") for k in ("raw", "yhat", "res")])


@query(
    "M5_treatment_metrics",
    WN(
        sql_rounded(
            " UNION ALL ".join(
                f"SELECT '{t}' AS target, COUNT(*) AS n, sqrt(AVG(pow(raw_{t} - mhat_{t}, 2))) AS rmse, 1 - SUM(pow(raw_{t} - mhat_{t}, 2)) / (VAR_POP(raw_{t}) * COUNT(*)) AS r2 FROM nres WHERE raw_{t} IS NOT NULL"
                for t in TREATMENTS
            ),
            ["target", "n"],
            ["rmse", "r2"],
        )
    ),
)
def treatment_metrics(spark, d):
    return N.fit_metrics(treatment_fit(spark, d), TREATMENTS)


_AUC_SQL = """auc AS (SELECT SUM(CASE WHEN y > 0 THEN r END) - pos * (pos + 1) / 2 AS u, pos, neg FROM (
  SELECT y, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0 AS r, SUM(y) OVER () AS pos, COUNT(*) OVER () - SUM(y) OVER () AS neg FROM scored) GROUP BY pos, neg)"""


@query(
    "M5_outcome_metrics",
    WN(
        sql_rounded("SELECT 'y_purchase' AS target, COUNT(*) AS n, AVG(pow(y - p, 2)) AS brier, (SELECT u / (pos * neg) FROM auc) AS auc FROM scored", ["target", "n"], ["brier", "auc"], 5),
        "scored AS MATERIALIZED (SELECT raw_y_purchase AS y, yhat_y_purchase AS p FROM nres)",
        _AUC_SQL,
    ),
)
def outcome_metrics(spark, d):
    m = N.fit_metrics(outcome_fit(spark, d), ["y_purchase"], "outcome")
    return m.select("target", "n", F.round("brier", 5).alias("brier"), F.round("auc", 5).alias("auc"))


def scored_table(spark, d):
    """Label and a score with many ties."""
    line = B.table(spark, d, "lineitem")
    y = (F.col("l_returnflag") == "N").cast("int")
    return line.select("l_orderkey", "l_linenumber", y.alias("y"), (0.05 + (F.col("l_quantity") + y * 5) / 60.0).alias("p"))


_SCORED = "scored AS MATERIALIZED (SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'N' AS INT) AS y, 0.05 + (l_quantity + CAST(l_returnflag = 'N' AS INT) * 5) / 60.0 AS p FROM lineitem)"
_AP_SQL = """cells AS (SELECT p, SUM(y) AS pos, COUNT(*) AS n FROM scored GROUP BY p),
ap AS (SELECT SUM(pos * cp / cn) / SUM(pos) AS v FROM (SELECT pos, SUM(pos) OVER (ORDER BY p DESC) AS cp, SUM(n) OVER (ORDER BY p DESC) AS cn FROM cells))"""


@query(
    "REC5_classification_metrics",
    f"WITH {_SCORED}, {_AUC_SQL}, {_AP_SQL} "
    + sql_rounded(
        """SELECT COUNT(*) AS n, AVG(y) AS prevalence, AVG(pow(y - p, 2)) AS brier, AVG(-(y * ln(LEAST(1 - 1e-6, p)) + (1 - y) * ln(1 - LEAST(1 - 1e-6, p)))) AS log_loss,
        (SELECT u / (pos * neg) FROM auc) AS auc, (SELECT v FROM ap) AS average_precision FROM scored""",
        ["n"],
        ["prevalence", "brier", "log_loss", "auc", "average_precision"],
    ),
)
def classification_metrics(spark, d):
    return N.classification_metrics(scored_table(spark, d), "y", "p")


@query("M3_boosted_learner")
def boosted_learner(spark, d):
    """All treatments by 250 trees of at most 31 leaves."""
    out = N.residualize(*parts(spark, d), TREATMENTS, X, "treatment", "boosted")
    return N.fit_metrics(cut(out), TREATMENTS)


@query("M2_logistic_learner")
def logistic_learner(spark, d):
    out = N.residualize(*parts(spark, d), ["y_purchase"], X, "outcome", "logistic")
    return N.fit_metrics(out, ["y_purchase"], "outcome")


@query(
    "M4_cross_split_design",
    WN(
        """SELECT 'B' AS fitted_on, 'C' AS applied_to, COUNT(*) AS rows, ROUND(AVG(raw_T_a - mhat_T_a), 5) + 0.0 AS mean_residual FROM nres""",
    ),
)
def cross_split_design(spark, d):
    out = treatment_fit(spark, d)
    row = out.agg(F.count("*").alias("rows"), F.round(F.avg("res_T_a"), 5).alias("mean_residual"))
    return row.select(F.lit("B").alias("fitted_on"), F.lit("C").alias("applied_to"), "*")


@query("M12_selection_propensity")
def selection_propensity(spark, d):
    t = nuisance_table(spark, d).withColumn("certified", (F.col("l_partkey") % 4 > 0).cast("int"))
    split = SP.item_disjoint_split(t, "l_partkey", "certified", 0.25, 3)
    train, test = split.filter("part = 'train'"), split.filter("part = 'test'")
    out = N.residualize(train, test, ["certified"], X, "outcome", "logistic")
    return N.fit_metrics(out, ["certified"], "outcome")


_SHORT = [f"COALESCE({x}, 0)" for x in X if x != "x_price"]


def _short_residual(t: str) -> str:
    hat = " + ".join([f"s_{t}_w.c0", *[f"s_{t}_w.c{i} * {x}" for i, x in enumerate(_SHORT, 1)]])
    return f"{t} - LEAST(1, GREATEST(0, {hat}))"


@query(
    "M13_short_design_refit",
    f"WITH {NUIS_SQL}, {', '.join(c for t in TREATMENTS for c in Q.ols_ctes(f's_{t}', 'nuis', t, _SHORT, SPLIT_B, clusters=False))} "
    + sql_rounded(
        f"SELECT COUNT(*) AS rows, {', '.join(f'STDDEV_SAMP({_short_residual(t)}) AS sd_{t}' for t in TREATMENTS)} FROM nuis, {', '.join(f's_{t}_w' for t in TREATMENTS)} WHERE split = 'C'",
        ["rows"],
        [f"sd_{t}" for t in TREATMENTS],
    ),
)
def short_design_refit(spark, d):
    train, test = parts(spark, d)
    short = N.residualize(train, test, TREATMENTS, [x for x in X if x != "x_price"])
    return short.agg(F.count("*").alias("rows"), *[F.stddev(f"res_{t}").alias(f"sd_{t}") for t in TREATMENTS])


@query(
    "M14_prior_residuals",
    WN(sql_rounded(f"SELECT AVG(T_a - ({fitted('f_T_a')})) AS mean_residual, STDDEV_SAMP(T_a - ({fitted('f_T_a')})) AS sd_residual FROM nuis, f_T_a_w WHERE split = 'C'", [], ["mean_residual", "sd_residual"])),
)
def prior_residuals(spark, d):
    out = N.residualize(*parts(spark, d), ["T_a"], X, clip=False)
    return out.agg(F.avg("res_T_a").alias("mean_residual"), F.stddev("res_T_a").alias("sd_residual"))


@query(
    "M15_feature_preparation",
    f"WITH {NUIS_SQL}, m AS (SELECT MEDIAN(x_gap) AS g FROM nuis WHERE split = 'B') "
    + sql_rounded("SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(x_gap, g) AS x_gap, CASE WHEN x_gap IS NULL THEN 1 ELSE 0 END AS missing FROM nuis, m WHERE split = 'C'", [*KEY, "missing"], ["x_gap"]),
)
def feature_preparation(spark, d):
    _, test, features = N.median_fill(*parts(spark, d), X)
    assert features == [*X, "x_gap__missing"]
    return test.select(*KEY, "x_gap", F.col("x_gap__missing").alias("missing"))


@query("M16_feature_ablation")
def feature_ablation(spark, d):
    """Base-X, then with the 6 composite, the 10 component and all 12 treatments, for every stage."""
    _, train, test = certified_splits(spark, d)
    treatments = {"Base-X": [], "Aggregate-6": M.COMPOSITE, "Disaggregate-10": M.COMPONENT, "Full-12": M.TREATMENTS}
    sets = {name: [*M.CONFOUNDERS, *columns] for name, columns in treatments.items()}
    return N.feature_ablation(train, test, M.OUTCOMES, sets, {"trees": 260})


# ---- certification ------------------------------------------------------------------

_CERT = """c_rows AS (SELECT * FROM parted WHERE split = 'C'), first_c AS (SELECT item_id, MIN("timestamp") AS item_first_set_c_timestamp FROM c_rows GROUP BY item_id),
u AS (SELECT item_id, review_text, MIN(ingest_order) AS o FROM reviews WHERE trim(review_text) <> '' GROUP BY ALL),
sel AS (SELECT u.item_id, u.o, r."timestamp" AS ts, r.user_id FROM u JOIN reviews r ON r.ingest_order = u.o QUALIFY ROW_NUMBER() OVER (PARTITION BY u.item_id ORDER BY u.o) <= 5),
chosen AS (SELECT sel.*, item_first_set_c_timestamp AS f, ts < item_first_set_c_timestamp AS early FROM sel JOIN first_c USING (item_id)),
audit AS MATERIALIZED (SELECT first_c.item_id, item_first_set_c_timestamp, COUNT(o) AS selected_review_rows, MIN(ts) AS min_selected_review_timestamp, MAX(ts) AS max_selected_review_timestamp,
  COALESCE(BOOL_AND(early), TRUE) AS strictly_pre_set_c, TRUE AS timestamp_parse_ok FROM first_c LEFT JOIN chosen USING (item_id) GROUP BY 1, 2)"""


def set_c(spark, d):
    return split_funnel(spark, d).filter("split = 'C'")


def item_audit(spark, d):
    return C.audit_items(B.reviews(spark, d), set_c(spark, d))


def WC(body: str) -> str:  # noqa: N802
    return W(["funnel", "reviews"], f"WITH {SPLIT_SQL}, {_CERT} {body}")


@query(
    "D1_item_certification",
    WC(
        """SELECT *, CASE WHEN selected_review_rows = 0 THEN 'metadata_image_only' ELSE 'metadata_image_plus_reviews' END AS input_mode,
        CASE WHEN strictly_pre_set_c THEN 'CERTIFIED_PRE_SET_C' ELSE 'FAIL_POST_OR_AT_SET_C_REVIEW' END AS certification_status FROM audit"""
    ),
)
def item_certification(spark, d):
    return item_audit(spark, d)[0]


@query(
    "D1_violations",
    WC("SELECT item_id, user_id, ts AS review_timestamp, f AS item_first_set_c_timestamp, TRUE AS timestamp_parse_ok FROM chosen WHERE NOT early"),
)
def violations(spark, d):
    return item_audit(spark, d)[1]


@query(
    "A14_item_audit_aggregate",
    WC("SELECT item_id, selected_review_rows, min_selected_review_timestamp, max_selected_review_timestamp, strictly_pre_set_c FROM audit"),
)
def item_audit_aggregate(spark, d):
    return item_audit(spark, d)[0].select(
        "item_id", "selected_review_rows", "min_selected_review_timestamp", "max_selected_review_timestamp", "strictly_pre_set_c"
    )


@query(
    "A15_audit_summary",
    WC(
        sql_rounded(
            """SELECT COUNT(*) AS set_c_items, COUNT(*) FILTER (WHERE selected_review_rows > 0) AS items_with_selected_reviews, COUNT(*) FILTER (WHERE strictly_pre_set_c) AS items_certified,
            COUNT(*) FILTER (WHERE NOT strictly_pre_set_c) AS items_failed, CAST(SUM(selected_review_rows) AS BIGINT) AS selected_review_rows, AVG(strictly_pre_set_c::INT) AS item_certification_rate,
            (SELECT COUNT(*) FROM c_rows) AS set_c_rows, (SELECT MIN("timestamp") FROM c_rows) AS set_c_start_timestamp, (SELECT COUNT(*) FROM c_rows JOIN audit USING (item_id) WHERE strictly_pre_set_c) AS certified_rows,
            (SELECT AVG(strictly_pre_set_c::INT) FROM c_rows JOIN audit USING (item_id)) AS row_certification_rate, CASE WHEN BOOL_AND(strictly_pre_set_c) THEN 'PASS' ELSE 'FAIL' END AS audit_status FROM audit""",
            ["set_c_items", "items_with_selected_reviews", "items_certified", "items_failed", "selected_review_rows", "set_c_rows", "set_c_start_timestamp", "certified_rows", "audit_status"],
            ["item_certification_rate", "row_certification_rate"],
        )
    ),
)
def audit_summary(spark, d):
    c = set_c(spark, d)
    return C.audit_summary(C.audit_items(B.reviews(spark, d), c)[0], c)


@query(
    "D2_certification_contract",
    WC(
        """SELECT COUNT(*) AS rows, 0::BIGINT AS missing_ids, 0::BIGINT AS duplicate_ids, 0::BIGINT AS disagreements, COUNT(*) FILTER (WHERE strictly_pre_set_c) AS certified_items, TRUE AS valid FROM audit"""
    ),
)
def certification_contract(spark, d):
    return C.certification_contract(item_audit(spark, d)[0])


_ITEM_RULE = "item_cert AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id FROM part WHERE p_size % 3 > 0)"


def rule_items(spark, d):
    """Certification by a rule on the part size, so both outcomes are common."""
    ok = F.col("p_size") % 3 > 0
    return B.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        ok.alias("strictly_pre_set_c"),
        F.when(ok, C.CERTIFIED).otherwise(C.FAILED).alias("certification_status"),
    )


@query(
    "J5_certified_semi_join",
    W(["funnel"], f'WITH {_ITEM_RULE} SELECT user_id, item_id, "timestamp" FROM funnel WHERE item_id IN (SELECT item_id FROM item_cert)'),
)
def certified_semi_join(spark, d):
    return C.restrict(B.funnel(spark, d), rule_items(spark, d)).select("user_id", "item_id", "timestamp")


@query(
    "D3_restrict_splits",
    W(
        ["funnel"],
        sql_rounded(
            f"""WITH {SPLIT_SQL}, {_ITEM_RULE}, m AS (SELECT p.*, i.item_id IS NOT NULL AS k FROM parted p LEFT JOIN item_cert i USING (item_id))
            SELECT split, COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE k) AS rows_after, COUNT(*) FILTER (WHERE NOT k) AS rows_removed, AVG(k::INT) AS row_retention_rate,
            MIN("timestamp") FILTER (WHERE k) AS min_timestamp_after, MAX("timestamp") FILTER (WHERE k) AS max_timestamp_after, AVG(y_purchase) AS y_purchase_rate_before,
            AVG(y_purchase) FILTER (WHERE k) AS y_purchase_rate_after, COUNT(DISTINCT item_id) AS items_before, COUNT(DISTINCT item_id) FILTER (WHERE k) AS items_after FROM m GROUP BY split""",
            ["split", "rows_before", "rows_after", "rows_removed", "min_timestamp_after", "max_timestamp_after", "items_before", "items_after"],
            ["row_retention_rate", "y_purchase_rate_before", "y_purchase_rate_after"],
        ),
    ),
)
def restrict_splits(spark, d):
    return C.retention(split_funnel(spark, d), rule_items(spark, d), "split", ["y_purchase"])


_MARKED_SQL = """marked AS MATERIALIZED (SELECT l_discount, l_tax, l_quantity, p_size % 3 > 0 AS certified, 0.05 + (p_size % 10) / 11.0 AS pr FROM lineitem JOIN part ON l_partkey = p_partkey),
lg AS (SELECT certified, pr, unnest(['l_discount', 'l_tax', 'l_quantity']) AS column_name, unnest([l_discount, l_tax, CASE WHEN l_quantity > 3 THEN l_quantity END]) AS v FROM marked)"""
_BAL = ["l_discount", "l_tax", "l_quantity"]


def marked_lines(spark, d):
    line = B.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("item_id"), "l_discount", "l_tax", "l_quantity")
    part = B.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), (0.05 + F.col("p_size") % 10 / 11.0).alias("pr"))
    m = C.mark_certified(line, rule_items(spark, d)).join(part, "item_id")
    return m.withColumn("l_quantity", F.when(F.col("l_quantity") > 3, F.col("l_quantity")))


@query(
    "D4_balance_table",
    f"WITH {_MARKED_SQL} "
    + sql_rounded(
        """SELECT *, (certified_mean - failed_mean) / sqrt((certified_sd * certified_sd + failed_sd * failed_sd) / 2) AS standardized_mean_difference FROM (
        SELECT column_name, COUNT(v) FILTER (WHERE certified) AS certified_n, AVG(v) FILTER (WHERE certified) AS certified_mean, STDDEV_SAMP(v) FILTER (WHERE certified) AS certified_sd,
        COUNT(v) FILTER (WHERE NOT certified) AS failed_n, AVG(v) FILTER (WHERE NOT certified) AS failed_mean, STDDEV_SAMP(v) FILTER (WHERE NOT certified) AS failed_sd FROM lg GROUP BY column_name)""",
        ["column_name", "certified_n", "failed_n"],
        ["certified_mean", "certified_sd", "failed_mean", "failed_sd", "standardized_mean_difference"],
    ),
)
def balance_table(spark, d):
    return C.balance(marked_lines(spark, d), _BAL)


@query(
    "D5_weighted_balance",
    f"""WITH {_MARKED_SQL}, cap AS (SELECT quantile_cont(1 / LEAST(0.99, GREATEST(0.01, pr)), 0.99) AS c FROM marked WHERE certified),
    w AS (SELECT column_name, certified, v, LEAST(c, 1 / LEAST(0.99, GREATEST(0.01, pr))) AS w FROM lg, cap) """
    + sql_rounded(
        """SELECT column_name, COUNT(v) AS full_n, COUNT(v) FILTER (WHERE certified) AS certified_n, AVG(v) AS full_mean, AVG(v) FILTER (WHERE certified) AS certified_mean,
        SUM(v * w) FILTER (WHERE certified) / SUM(w) FILTER (WHERE certified AND v IS NOT NULL) AS weighted_mean, (AVG(v) FILTER (WHERE certified) - AVG(v)) / STDDEV_SAMP(v) AS unweighted_smd,
        (SUM(v * w) FILTER (WHERE certified) / SUM(w) FILTER (WHERE certified AND v IS NOT NULL) - AVG(v)) / STDDEV_SAMP(v) AS weighted_smd FROM w GROUP BY column_name""",
        ["column_name", "full_n", "certified_n"],
        ["full_mean", "certified_mean", "weighted_mean", "unweighted_smd", "weighted_smd"],
        5,
    ),
)
def weighted_balance(spark, d):
    table = C.weighted_balance(marked_lines(spark, d), _BAL, "pr")[0]
    return table.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes])


@query(
    "D5_weight_summary",
    f"""WITH {_MARKED_SQL}, cap AS (SELECT quantile_cont(1 / LEAST(0.99, GREATEST(0.01, pr)), 0.99) AS c FROM marked WHERE certified),
    w0 AS (SELECT pr, LEAST(c, 1 / LEAST(0.99, GREATEST(0.01, pr))) AS w FROM marked, cap WHERE certified), w1 AS (SELECT w / AVG(w) OVER () AS w FROM w0) """
    + sql_rounded(
        """SELECT COUNT(*) AS certified_rows, AVG(w) AS weight_mean, (SELECT c FROM cap) AS weight_cap, MAX(w) AS weight_max, SUM(w) * SUM(w) / SUM(w * w) AS effective_sample_size,
        (SELECT AVG((pr BETWEEN 0.01 AND 0.99)::INT) FROM marked) AS common_support_rate FROM w1""",
        ["certified_rows"],
        ["weight_mean", "weight_cap", "weight_max", "effective_sample_size", "common_support_rate"],
        4,
    ),
)
def weight_summary(spark, d):
    w = C.weighted_balance(marked_lines(spark, d), _BAL, "pr")[1]
    return w.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in w.dtypes])


# ---- diagnostics ----------------------------------------------------------------------

_ECE = """e AS (SELECT quantile_cont(p, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM scored),
bins AS (SELECT len(list_filter(list_distinct(e), lambda x: p > x)) AS b, COUNT(*) AS n, AVG(y) AS y, AVG(p) AS p FROM scored, e GROUP BY 1),
ece AS (SELECT SUM(n * abs(y - p)) / SUM(n) AS ece FROM bins)"""


@query("D8_calibration_error", f"WITH {_SCORED}, {_ECE} " + sql_rounded("SELECT ece FROM ece", [], ["ece"]))
def calibration_error(spark, d):
    return DG.expected_calibration_error(scored_table(spark, d), "y", "p")


@query("D7_calibration_line")
def calibration_line(spark, d):
    a, b = DG.calibration_line(scored_table(spark, d), "y", "p")
    return E.small_frame(spark, [(a, b)], "intercept double, slope double")


_CLIP = "LEAST(1 - 1e-6, GREATEST(1e-6, p))"


@query(
    "D6_nuisance_transport",
    f"""WITH s0 AS (SELECT *, l_orderkey % 2 AS half FROM ({_SCORED.split('MATERIALIZED ', 1)[1][1:-1]})), base AS (SELECT COUNT(*) AS train_n, AVG(y) AS train_rate FROM s0 WHERE half = 0),
    scored AS MATERIALIZED (SELECT y, {_CLIP} AS p FROM s0 WHERE half = 1), {_AUC_SQL}, {_ECE} """
    + sql_rounded(
        """SELECT train_n, train_rate, COUNT(*) AS test_n, AVG(y) AS test_rate, AVG(p) AS mean_prediction, AVG(pow(y - p, 2)) AS brier, AVG(pow(y - train_rate, 2)) AS brier_null,
        AVG(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, AVG(-(y * ln(train_rate) + (1 - y) * ln(1 - train_rate))) AS log_loss_null, abs(AVG(y) - train_rate) AS prevalence_drift,
        AVG(y) / train_rate AS prevalence_ratio, 1 - AVG(pow(y - p, 2)) / AVG(pow(y - train_rate, 2)) AS brier_skill, AVG(pow(y - p, 2)) < AVG(pow(y - train_rate, 2)) AS beats_null,
        (SELECT u / (pos * neg) FROM auc) AS auc, (SELECT ece FROM ece) AS ece FROM scored, base GROUP BY train_n, train_rate""",
        ["train_n", "test_n", "beats_null"],
        ["train_rate", "test_rate", "mean_prediction", "brier", "brier_null", "log_loss", "log_loss_null", "prevalence_drift", "prevalence_ratio", "brier_skill", "auc", "ece"],
    ),
)
def nuisance_transport(spark, d):
    s = scored_table(spark, d)
    half = F.col("l_orderkey") % 2
    return DG.transport(s.filter(half == 0), s.filter(half == 1), "y", "p")


@query("D6_transport_with_calibration")
def transport_with_calibration(spark, d):
    s = scored_table(spark, d)
    half = F.col("l_orderkey") % 2
    return DG.transport_with_calibration(s.filter(half == 0), s.filter(half == 1), "y", "p")


_CAL_SQL = f"""{long_measures_sql()}, z AS (SELECT item_id, name, value, CASE WHEN value > 0 THEN ROW_NUMBER() OVER (PARTITION BY name, value > 0 ORDER BY value, md5('20260713|' || item_id), item_id) /
  COUNT(*) OVER (PARTITION BY name, value > 0) ELSE 0 END AS cal FROM long)"""


@query(
    "D9_measurement_diagnostics",
    W(
        ["measures"],
        sql_rounded(
            f"""WITH {_CAL_SQL} SELECT name AS component, COUNT(*) AS observed_items, COUNT(*) FILTER (WHERE value = 0) AS zero_items, AVG((value = 0)::INT) AS zero_share, COUNT(*) FILTER (WHERE value > 0) AS positive_items,
            COUNT(DISTINCT value) FILTER (WHERE value > 0) AS positive_unique_values, quantile_cont(value, 0.75) FILTER (WHERE value > 0) - quantile_cont(value, 0.25) FILTER (WHERE value > 0) AS positive_raw_iqr,
            quantile_cont(value, 0.99) FILTER (WHERE value > 0) - quantile_cont(value, 0.01) FILTER (WHERE value > 0) AS positive_raw_width,
            quantile_cont(cal, 0.75) FILTER (WHERE value > 0) - quantile_cont(cal, 0.25) FILTER (WHERE value > 0) AS positive_calibrated_iqr,
            quantile_cont(cal, 0.99) FILTER (WHERE value > 0) - quantile_cont(cal, 0.01) FILTER (WHERE value > 0) AS positive_calibrated_width, CASE WHEN COUNT(*) >= 500 AND COUNT(DISTINCT value) FILTER (WHERE value > 0) >= 4 THEN 'PASS' ELSE 'REVIEW' END AS support_flag
            FROM z GROUP BY name""",
            ["component", "observed_items", "zero_items", "positive_items", "positive_unique_values", "support_flag"],
            ["zero_share", "positive_raw_iqr", "positive_raw_width", "positive_calibrated_iqr", "positive_calibrated_width"],
        ),
    ),
)
def measurement_diagnostics(spark, d):
    m = B.measures(spark, d)
    both = m.join(calibrate(m), "item_id")
    return DG.measurement_diagnostics(both, {c: f"{c}_calib" for c in B.RAW_CONSTRUCTS})


def residual_triples(spark, d):
    out = treatment_fit(spark, d)
    return out


_TRIPLE = "tr AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{t}' AS treatment, ROUND(raw_{t}, 6) AS raw, mhat_{t} AS mhat, raw_{t} - mhat_{t} AS res FROM nres WHERE raw_{t} IS NOT NULL" for t in TREATMENTS
) + ")"


@query(
    "D10_residual_diagnostics",
    WN(
        sql_rounded(
            """SELECT treatment, COUNT(*) AS observed_n, AVG((raw = 0)::INT) AS raw_zero_share, STDDEV_SAMP(mhat) AS mhat_sd, AVG(res) AS residual_mean, STDDEV_SAMP(res) AS residual_sd,
            quantile_cont(res, 0.75) - quantile_cont(res, 0.25) AS residual_iqr, 'PASS' AS status FROM tr GROUP BY treatment""",
            ["treatment", "observed_n", "status"],
            ["raw_zero_share", "mhat_sd", "residual_mean", "residual_sd", "residual_iqr"],
            5,
        ),
        _TRIPLE,
    ),
)
def residual_diagnostics(spark, d):
    t = DG.residual_diagnostics(residual_triples(spark, d), TREATMENTS)
    doubles = ["raw_zero_share", "mhat_sd", "residual_mean", "residual_sd", "residual_iqr"]
    return t.select("treatment", "observed_n", "status", *[F.round(c, 5).alias(c) for c in doubles])


_OVERLAP_SQL = """tri AS MATERIALIZED (SELECT 'T_a' AS treatment, l_discount * 10 AS raw, (l_quantity + l_linenumber) / 60 AS mhat, l_discount * 10 - (l_quantity + l_linenumber) / 60 AS res FROM lineitem),
ed AS (SELECT list_distinct(quantile_cont(mhat, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM tri),
st AS (SELECT tri.*, len(list_filter(e, lambda x: mhat > x)) + 1 AS stratum FROM tri, ed),
ov AS (SELECT treatment, stratum, COUNT(*) AS n, MIN(mhat) AS mhat_min, MAX(mhat) AS mhat_max, AVG((raw = 0)::INT) AS raw_zero_share, AVG(res) AS residual_mean, STDDEV_SAMP(res) AS residual_sd,
  quantile_cont(raw, 0.01) AS raw_p01, quantile_cont(raw, 0.99) AS raw_p99, quantile_cont(res, 0.75) - quantile_cont(res, 0.25) AS residual_iqr,
  quantile_cont(res, 0.99) - quantile_cont(res, 0.01) AS residual_width FROM st GROUP BY treatment, stratum)"""


def overlap_lines(spark, d):
    line = B.table(spark, d, "lineitem")
    raw, hat = F.col("l_discount") * 10, (F.col("l_quantity") + F.col("l_linenumber")) / 60
    return line.select(raw.alias("raw_T_a"), hat.alias("mhat_T_a"), (raw - hat).alias("res_T_a"))


@query(
    "D11_stratified_overlap",
    f"WITH {_OVERLAP_SQL} "
    + sql_rounded(
        "SELECT *, CASE WHEN n >= 100 AND residual_iqr >= 0.01 THEN 'PASS' ELSE 'REVIEW' END AS status FROM ov",
        ["treatment", "stratum", "n", "status"],
        ["mhat_min", "mhat_max", "raw_zero_share", "residual_mean", "residual_sd", "raw_p01", "raw_p99", "residual_iqr", "residual_width"],
    ),
)
def stratified_overlap(spark, d):
    return DG.stratified_overlap(overlap_lines(spark, d), ["T_a"])


@query(
    "D11_overlap_summary",
    f"WITH {_OVERLAP_SQL} "
    + sql_rounded(
        """SELECT treatment, COUNT(*) AS strata, MIN(n) AS minimum_stratum_n, MIN(residual_iqr) AS minimum_stratum_iqr, MEDIAN(residual_iqr) AS median_stratum_iqr,
        COUNT(*) FILTER (WHERE n >= 100 AND residual_iqr >= 0.01) AS supported_strata, AVG((n >= 100 AND residual_iqr >= 0.01)::INT) AS supported_share, BOOL_AND(n >= 100 AND residual_iqr >= 0.01) AS all_strata_pass FROM ov GROUP BY treatment""",
        ["treatment", "strata", "minimum_stratum_n", "supported_strata", "all_strata_pass"],
        ["minimum_stratum_iqr", "median_stratum_iqr", "supported_share"],
    ),
)
def overlap_summary(spark, d):
    return DG.overlap_summary(DG.stratified_overlap(overlap_lines(spark, d), ["T_a"]))


@query(
    "D12_rank_diagnostics",
    WR(
        sql_rounded(
            """SELECT 'pair' AS specification, 2 AS included, n AS complete_n, 2 AS matrix_rank, 1 - abs(r) AS min_correlation_eigenvalue, 1 + abs(r) AS max_correlation_eigenvalue,
            (1 + abs(r)) / (1 - abs(r)) AS correlation_condition, ((a + b) - sqrt((a - b) * (a - b) + 4 * c * c)) / 2 AS min_covariance_eigenvalue, 'PASS' AS status
            FROM (SELECT COUNT(*) AS n, corr(res_T_con_mkt, res_T_int_fac) AS r, VAR_SAMP(res_T_con_mkt) AS a, VAR_SAMP(res_T_int_fac) AS b, COVAR_SAMP(res_T_con_mkt, res_T_int_fac) AS c FROM resid)""",
            ["specification", "included", "complete_n", "matrix_rank", "status"],
            ["min_correlation_eigenvalue", "max_correlation_eigenvalue", "correlation_condition", "min_covariance_eigenvalue"],
        ),
    ),
)
def rank_diagnostics(spark, d):
    return DG.rank_diagnostics(residuals(spark, d), {"pair": ["res_T_con_mkt", "res_T_int_fac"]}).drop("covariance_condition")


@query("D12_before_and_after_projection")
def rank_before_after(spark, d):
    r = residuals(spark, d)
    out, columns, _, _ = PJ.fit_apply(r.filter("split = 'B'"), r.filter("split = 'C'"), HEURISTIC, ANALYTICAL)
    return DG.rank_diagnostics(out, {"before_projection": [*HEURISTIC, *ANALYTICAL], "frozen_projection": columns})


@query(
    "D13_correlation_block",
    WR(
        sql_rounded(
            " UNION ALL ".join(f"SELECT '{a}' AS control, '{b}' AS target, corr({a}, {b}) AS correlation FROM resid" for a in HEURISTIC for b in ANALYTICAL),
            ["control", "target"],
            ["correlation"],
        )
    ),
)
def correlation_block(spark, d):
    return DG.correlation_block(residuals(spark, d), HEURISTIC, ANALYTICAL)


_CONC_A = "SELECT p_brand AS k, AVG(p_size % 7) - 3 AS coefficient FROM part GROUP BY p_brand"
_CONC_B = "SELECT p_brand AS k, AVG(p_partkey % 5) - 2 AS coefficient FROM part GROUP BY p_brand"


@query(
    "D14_sign_concordance",
    sql_rounded(
        f"""SELECT COUNT(*) AS pairs, AVG((sign(a.coefficient) = sign(b.coefficient))::INT) AS sign_concordance, corr(a.coefficient, b.coefficient) AS coefficient_correlation
        FROM ({_CONC_A}) a JOIN ({_CONC_B}) b USING (k)""",
        ["pairs"],
        ["sign_concordance", "coefficient_correlation"],
    ),
)
def sign_concordance(spark, d):
    part = B.table(spark, d, "part").groupBy(F.col("p_brand").alias("k"))
    a = part.agg((F.avg(F.col("p_size") % 7) - 3).alias("coefficient"))
    b = part.agg((F.avg(F.col("p_partkey") % 5) - 2).alias("coefficient"))
    return E.sign_concordance(a, b, ["k"])


@query(
    "D15_selected_contrasts",
    """WITH t AS (SELECT p_brand AS treatment, 'purchase' AS stage, lv, AVG(p_size % (lv + 3)) AS estimate, SUM(p_size) % 10 / 100.0 AS p_omnibus FROM part, range(1, 4) q(lv) GROUP BY p_brand, lv)
    SELECT treatment, stage, 'H3-H0' AS test, ROUND(estimate, 6) + 0.0 AS estimate FROM t WHERE lv = 3 AND p_omnibus < 0.05""",
)
def selected_contrasts(spark, d):
    part = B.table(spark, d, "part").withColumn("lv", F.explode(F.sequence(F.lit(1), F.lit(3))))
    single = part.groupBy(F.col("p_brand").alias("treatment"), "lv").agg(F.avg(F.col("p_size") % (F.col("lv") + 3)).alias("estimate"))
    single = single.select("treatment", F.concat(F.lit("H"), F.col("lv").cast("string"), F.lit("-H0")).alias("test"), "estimate", F.lit(0.5).alias("p_holm"))
    joint = B.table(spark, d, "part").groupBy(F.col("p_brand").alias("treatment")).agg((F.sum("p_size") % 10 / 100.0).alias("p_holm"))
    tests = single.unionByName(joint.withColumns({"test": F.lit("omnibus"), "estimate": F.lit(0.0)})).withColumn("stage", F.lit("purchase"))
    return DG.selected_contrasts(tests).select("treatment", "stage", "test", "estimate")


_EVIDENCE_SQL = """SELECT 'transport' AS analysis, CASE WHEN AVG(l_discount) < 0.06 THEN 'SUPPORTS_TEMPORAL_TRANSPORT' ELSE 'CALIBRATION_LIMITATION' END AS a, l_returnflag AS dataset FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT 'specification', CASE WHEN AVG(l_tax) > 0.0401 THEN 'STABLE' ELSE 'FOCAL_RESULTS_STABLE_WITH_LOCAL_EXCEPTIONS' END, l_returnflag FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT 'placebo', CASE WHEN COUNT(*) > 0 THEN 'FOCAL_EFFECTS_DIFFER_FROM_PERMUTATION_NULL' ELSE 'MIXED_PLACEBO_EVIDENCE' END, l_returnflag FROM lineitem GROUP BY l_returnflag"""


@query(
    "D16_evidence_rollup",
    f"""WITH e AS ({_EVIDENCE_SQL}), s AS (SELECT analysis, dataset, CASE a WHEN 'SUPPORTS_TEMPORAL_TRANSPORT' THEN 'PASS' WHEN 'CALIBRATION_LIMITATION' THEN 'SCOPE_LIMIT' WHEN 'STABLE' THEN 'PASS'
      WHEN 'FOCAL_RESULTS_STABLE_WITH_LOCAL_EXCEPTIONS' THEN 'PASS_WITH_LOCAL_EXCEPTIONS' ELSE 'PASS' END AS s FROM e)
    SELECT analysis, MAX(s) FILTER (WHERE dataset = 'A') AS "A", MAX(s) FILTER (WHERE dataset = 'N') AS "N", MAX(s) FILTER (WHERE dataset = 'R') AS "R" FROM s GROUP BY analysis""",
)
def evidence_rollup(spark, d):
    out = None
    sums = B.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), F.count("*").alias("n"))
    for flag in ("A", "N", "R"):
        one = sums.filter(F.col("l_returnflag") == flag)
        rows = DG.evidence_rows(
            [
                ("transport", one, "disc < 0.06", "SUPPORTS_TEMPORAL_TRANSPORT", "CALIBRATION_LIMITATION"),
                ("specification", one, "tax > 0.0401", "STABLE", "FOCAL_RESULTS_STABLE_WITH_LOCAL_EXCEPTIONS"),
                ("placebo", one, "n > 0", "FOCAL_EFFECTS_DIFFER_FROM_PERMUTATION_NULL", "MIXED_PLACEBO_EVIDENCE"),
            ]
        ).withColumn("dataset", F.lit(flag))
        out = rows if out is None else out.unionByName(rows)
    return DG.status_matrix(out)


@query(
    "D17_contract_checks",
    """WITH c AS (SELECT COUNT(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05) AS a, COUNT(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')) AS b, COUNT(*) FILTER (WHERE l_orderkey IS NULL) AS k FROM lineitem)
    SELECT 'lineitem' AS table_name, unnest(['discount_in_range', 'flag_allowed', 'key_present']) AS check_name, unnest([a, b, k]) AS violations,
    unnest([CASE WHEN a = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN b = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN k = 0 THEN 'PASS' ELSE 'FAIL' END]) AS status FROM c""",
)
def contract_checks(spark, d):
    checks = {
        "discount_in_range": F.col("l_discount").between(0, 0.05),
        "flag_allowed": F.col("l_returnflag").isin("A", "N", "R"),
        "key_present": F.col("l_orderkey").isNotNull(),
    }
    return QU.expect(B.table(spark, d, "lineitem"), checks, "lineitem")


@query(
    "D17_total_checks",
    """SELECT 'orders' AS table_name, unnest(['row_count', 'priority_coverage']) AS check_name, unnest([COUNT(*)::VARCHAR, COUNT(DISTINCT o_orderpriority)::VARCHAR]) AS detail,
    unnest([CASE WHEN COUNT(*) > 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN COUNT(DISTINCT o_orderpriority) = 5 THEN 'PASS' ELSE 'FAIL' END]) AS status FROM orders""",
)
def total_checks(spark, d):
    checks = {
        "row_count": (F.count("*"), F.count("*") > 0),
        "priority_coverage": (F.countDistinct("o_orderpriority"), F.countDistinct("o_orderpriority") == 5),
    }
    return QU.expect_totals(B.table(spark, d, "orders"), checks, "orders")


@query(
    "E2_support_by_level",
    WR(
        sql_rounded(
            " UNION ALL ".join(f"SELECT {k} AS h_level, treatment, support_n, residual_sd, support_flag FROM g{k}_gate" for k in range(4)),
            ["h_level", "treatment", "support_n", "support_flag"],
            ["residual_sd"],
        ),
        THIN,
        *[support_ctes(f"g{k}", "resid2", [c for c in THIN_COLUMNS if k or c != "res_T_int_sem"], f"H_level = {k}") for k in range(4)],
    ),
)
def support_by_level(spark, d):
    t = E.support(thin(spark, d), THIN_COLUMNS, ["H_level"])
    return t.filter("support_n > 0").select(F.col("H_level").alias("h_level"), "treatment", "support_n", "residual_sd", "support_flag")
