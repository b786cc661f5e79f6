"""Queries: sampling, candidates, ranking evaluation, re-ranking and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelweir.functions.hashing import hash_int
from funnelweir.operators import agreement as AG
from funnelweir.operators import candidates as CA
from funnelweir.operators import effects as E
from funnelweir.operators import funnel as FN
from funnelweir.operators import history as H
from funnelweir.operators import ordering as O
from funnelweir.operators import ranking as RK
from funnelweir.operators import ranks as R
from funnelweir.operators import recommend as RC
from funnelweir.operators import sampling as SA
from funnelweir.operators import splits as SP
from funnelweir.plans import tables as B
from funnelweir.plans.features import PRIOR_SQL, SPLIT_SQL, split_funnel
from funnelweir.plans import oracle as Q
from funnelweir.plans.registry import query, sql_rounded
from funnelweir.plans.residuals import ANALYTICAL, HEURISTIC, OUTCOMES, residuals
from funnelweir.sources.tables import spread
from funnelweir.session import cut, stored

W = B.sql_with
SEED = 5
STAGE = "purchase"
NEGATIVES = 99


def hash_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 12))::BIGINT"


# ---- draws -------------------------------------------------------------------------

_POOL = """pool AS MATERIALIZED (SELECT CAST(p_partkey AS VARCHAR) AS item_id, ROW_NUMBER() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) - 1 AS idx FROM part),
sz AS (SELECT COUNT(*) AS n FROM part), seen AS MATERIALIZED (SELECT DISTINCT user_id, item_id FROM funnel WHERE y_purchase = 1)"""


def rejection_sql(rows: str, keys: list[str], user: str, k: int, limit: int, seed, seen: str = "seen") -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f'"{c}"' for c in keys], "attempt"])
    return f"""drawn AS MATERIALIZED (SELECT *, {hash_sql(text)} % n AS idx FROM (SELECT r.*, unnest(generate_series(1, {limit})) AS attempt FROM {rows} r), sz),
    fresh AS MATERIALIZED (SELECT d.*, p.item_id AS pick FROM drawn d JOIN pool p USING (idx) WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.user_id = d.{user} AND s.item_id = p.item_id)),
    kept AS (SELECT * FROM fresh QUALIFY ROW_NUMBER() OVER (PARTITION BY {', '.join(f'"{c}"' for c in keys)} ORDER BY attempt) <= {k})"""


def purchases(spark, d):
    return B.funnel(spark, d).filter("y_purchase = 1").select("user_id", "item_id", "timestamp")


@query(
    "R1_sampled_alternatives",
    W(
        ["funnel"],
        f"""WITH {_POOL}, pos AS (SELECT user_id, item_id, "timestamp" FROM funnel WHERE y_purchase = 1),
        {rejection_sql('pos', ['user_id', 'item_id', 'timestamp'], 'user_id', 5, 30, SEED)}
        SELECT user_id, item_id, "timestamp", pick AS sampled_item, attempt::INT AS attempt FROM kept""",
    ),
)
def sampled_alternatives(spark, d):
    pos = purchases(spark, d)
    # 150 attempts are the limit; 30 decide every row of this table
    return SA.rejection_draws(pos, ["user_id", "item_id", "timestamp"], "user_id", B.items(spark, d), "item_id", pos, 5, SEED, 10, 150)


@query(
    "R4_training_triples",
    W(
        ["funnel"],
        f"""WITH {_POOL}, rows5 AS (SELECT user_id, item_id, unnest(generate_series(0, 4)) AS sample FROM seen),
        {rejection_sql('rows5', ['sample', 'user_id', 'item_id'], 'user_id', 1, 12, SEED)}
        SELECT sample::INT AS sample, user_id, item_id, pick AS negative FROM kept""",
    ),
)
def training_triples(spark, d):
    edges = FN.interaction_edges(B.funnel(spark, d), STAGE)
    return SA.training_triples(edges, "user_id", "item_id", B.items(spark, d), 5, SEED)


def candidates_sql(train: str, test: str, stage: str, k: int, seed) -> str:
    return f"""edges AS MATERIALIZED (SELECT DISTINCT user_id, item_id FROM {train} WHERE y_{stage} = 1),
    targets AS MATERIALIZED (SELECT user_id, item_id FROM {test} t WHERE y_{stage} = 1 AND EXISTS (SELECT 1 FROM edges e WHERE e.user_id = t.user_id) AND EXISTS (SELECT 1 FROM edges e WHERE e.item_id = t.item_id)
      QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, item_id DESC) = 1),
    wp AS MATERIALIZED (SELECT item_id, ROW_NUMBER() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM edges)),
    wn AS (SELECT COUNT(*) AS n FROM wp),
    pr AS MATERIALIZED (SELECT n, MIN(p) AS prime FROM (SELECT n, unnest(generate_series(n, n + 300)) AS p FROM wn) WHERE len(list_filter(generate_series(2, CAST(floor(sqrt(p)) AS BIGINT)), lambda q: p % q = 0)) = 0 GROUP BY n),
    blocked AS MATERIALIZED (SELECT DISTINCT user_id, item_id FROM (SELECT user_id, item_id FROM {train} WHERE y_click = 1 UNION ALL SELECT user_id, item_id FROM {test} WHERE y_click = 1) JOIN wp USING (item_id)),
    steps AS MATERIALIZED (SELECT user_id, n, prime, LEAST(prime, {k} + prime - n + COALESCE(c, 0)) AS steps, {hash_sql(f"'{seed}|{stage}|stride|' || user_id")} % GREATEST(1, prime - 1) + 1 AS a,
      {hash_sql(f"'{seed}|{stage}|start|' || user_id")} % prime AS b FROM targets LEFT JOIN (SELECT user_id, COUNT(*) AS c FROM blocked GROUP BY user_id) USING (user_id), pr),
    walk AS MATERIALIZED (SELECT user_id, j, n, (a * j + b) % prime AS idx FROM (SELECT *, unnest(generate_series(0, steps - 1)) AS j FROM steps)),
    okay AS MATERIALIZED (SELECT w.user_id, wp.item_id, w.j FROM walk w JOIN wp USING (idx) WHERE NOT EXISTS (SELECT 1 FROM blocked x WHERE x.user_id = w.user_id AND x.item_id = wp.item_id)),
    neg AS MATERIALIZED (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY user_id) AS f FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY j) AS r FROM okay) WHERE r <= {k}) WHERE f = {k}),
    cand AS MATERIALIZED (SELECT '{stage}' AS stage, user_id, item_id, FALSE AS is_target FROM neg UNION ALL SELECT '{stage}', user_id, item_id, TRUE FROM targets WHERE user_id IN (SELECT user_id FROM neg))"""


_BC = "set_b AS MATERIALIZED (SELECT * FROM parted WHERE split = 'B'), set_c AS MATERIALIZED (SELECT * FROM parted WHERE split = 'C')"
CAND_SQL = f"{SPLIT_SQL}, {_BC}, {candidates_sql('set_b', 'set_c', STAGE, NEGATIVES, SEED)}"


def set_b_c(spark, d):
    # stored before the boundaries are looked for, which read the rows too
    s = SP.temporal_split(stored(B.funnel(spark, d)), "timestamp")
    return s.filter("split = 'B'"), s.filter("split = 'C'")


def candidates(spark, d):
    return CA.stage_candidates(*set_b_c(spark, d), STAGE, NEGATIVES, SEED)


@query("R2_candidates", W(["funnel"], f"WITH {CAND_SQL} SELECT * FROM cand"))
def stage_candidates(spark, d):
    return candidates(spark, d)


@query(
    "R3_validation_candidates",
    W(
        ["funnel"],
        f"""WITH {SPLIT_SQL}, b0 AS MATERIALIZED (SELECT * FROM parted WHERE split = 'B'), dd AS (SELECT "timestamp" AS ts, COUNT(*) AS c FROM b0 GROUP BY 1),
        rr AS (SELECT ts, SUM(c) OVER (ORDER BY ts) AS e, SUM(c) OVER () AS n FROM dd), cutoff AS (SELECT MIN(ts) AS ts FROM rr WHERE e >= FLOOR(n * 0.75)),
        tr AS MATERIALIZED (SELECT b0.* FROM b0, cutoff WHERE "timestamp" <= ts), va AS MATERIALIZED (SELECT b0.* FROM b0, cutoff WHERE "timestamp" > ts),
        {candidates_sql('tr', 'va', 'click', 49, 9)} SELECT * FROM cand""",
    ),
)
def validation_candidates(spark, d):
    b = set_b_c(spark, d)[0].drop("split")
    both = SP.train_validation(b, "timestamp", 0.25)
    return CA.stage_candidates(both.filter("part = 'train'"), both.filter("part = 'validation'"), "click", 49, 9)


@query("W13_latest_targets", W(["funnel"], f"WITH {CAND_SQL} SELECT * FROM targets"))
def latest_targets(spark, d):
    return CA.latest_targets(*set_b_c(spark, d), STAGE)


@query(
    "J6_unseen_anti_join",
    W(
        ["funnel"],
        f"WITH {SPLIT_SQL}, {_BC} SELECT DISTINCT user_id, item_id FROM set_c WHERE NOT EXISTS (SELECT 1 FROM set_b WHERE set_b.user_id = set_c.user_id AND set_b.item_id = set_c.item_id AND set_b.y_click = 1)",
    ),
)
def unseen_anti_join(spark, d):
    b, c = set_b_c(spark, d)
    return c.select("user_id", "item_id").distinct().join(CA.seen_items(b), ["user_id", "item_id"], "left_anti")


@query(
    "REC13_candidate_metadata",
    W(
        ["funnel"],
        f"""WITH {CAND_SQL}, tu AS (SELECT DISTINCT user_id FROM set_c WHERE y_purchase = 1) SELECT 'purchase' AS stage, (SELECT COUNT(*) FROM tu) AS positive_test_users,
        (SELECT COUNT(*) FROM targets) AS stage_warm_start_eligible_users, (SELECT COUNT(*) FROM tu WHERE user_id NOT IN (SELECT user_id FROM edges)) AS excluded_no_prior_stage_interaction,
        (SELECT COUNT(*) FROM tu WHERE user_id IN (SELECT user_id FROM edges) AND user_id NOT IN (SELECT user_id FROM targets)) AS excluded_no_stage_warm_target,
        (SELECT COUNT(DISTINCT user_id) FROM cand) AS evaluated_users, (SELECT COUNT(DISTINCT user_id) FROM edges) AS stage_train_users, (SELECT COUNT(DISTINCT item_id) FROM edges) AS stage_train_items,
        (SELECT COUNT(*) FROM edges) AS stage_train_edges""",
    ),
)
def candidate_metadata(spark, d):
    b, c = set_b_c(spark, d)
    return CA.candidate_metadata(b, c, STAGE, CA.stage_candidates(b, c, STAGE, NEGATIVES, SEED))


@query(
    "REC14_candidate_contract",
    W(
        ["funnel"],
        f"""WITH {CAND_SQL} SELECT 'purchase' AS stage, COUNT(*) AS users, MIN(n) AS candidate_size_min, MAX(n) AS candidate_size_max, 0::BIGINT AS invalid_user_ids, CAST(SUM(bad) AS BIGINT) AS invalid_item_ids,
        0::BIGINT AS duplicate_candidate_lists FROM (SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE CAST(item_id AS BIGINT) % 10 = 0) AS bad FROM cand GROUP BY user_id)""",
    ),
)
def candidate_contract(spark, d):
    known = B.items(spark, d).filter(F.col("item_id").cast("bigint") % 10 != 0)
    return CA.candidate_contract(candidates(spark, d), B.users(spark, d), known)


@query(
    "REC14_split_contract",
    W(
        ["funnel"],
        f"""WITH {SPLIT_SQL} SELECT split, COUNT(*) AS rows, COUNT(DISTINCT user_id) AS unique_users, COUNT(DISTINCT item_id) AS unique_items, COUNT(*) FILTER (WHERE y_purchase = 1) AS purchase_positive_rows,
        COUNT(*) FILTER (WHERE y_purchase = 0) AS purchase_negative_rows, MIN("timestamp") AS timestamp_min, MAX("timestamp") AS timestamp_max FROM parted GROUP BY split""",
    ),
)
def split_contract(spark, d):
    return CA.split_contract(split_funnel(spark, d), "split")


@query(
    "R5_nested_subsample",
    W(
        ["funnel"],
        f"""WITH {CAND_SQL}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY stage, user_id ORDER BY md5('{SEED}|1|' || stage || '|' || user_id || '|' || item_id)) AS k FROM cand WHERE NOT is_target)
        SELECT stage, user_id, item_id, is_target FROM r WHERE k <= 49 UNION ALL SELECT stage, user_id, item_id, is_target FROM cand WHERE is_target""",
    ),
)
def nested_subsample(spark, d):
    return SA.nested_subsample(candidates(spark, d), ["stage", "user_id"], "item_id", 49, SEED, 1)


_COLS = ["T_con_mkt", "T_int_vis", "T_int_fac", "atomic_a_pri", "atomic_a_gft"]
_STRATA = f"""m AS (SELECT *, ({' + '.join(_COLS)}) / {len(_COLS)}.0 AS mean, ({' + '.join(f'({c} = 0)::INT' for c in _COLS)}) AS zeros FROM measures),
q AS (SELECT list_distinct(quantile_cont(mean, [0.25, 0.5, 0.75])) AS e FROM m), s AS MATERIALIZED (SELECT item_id, CASE WHEN zeros = 0 THEN 'none' WHEN zeros <= 3 THEN 'some' ELSE 'many' END || '_' ||
  len(list_filter(e, lambda x: mean > x)) AS stratum, md5('{SEED}|' || item_id) AS h FROM m, q),
t AS (SELECT CEIL(150.0 / COUNT(DISTINCT stratum)) AS target FROM s), ph AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY h, item_id) <= (SELECT target FROM t) THEN 0 ELSE 1 END AS phase FROM s),
samp AS MATERIALIZED (SELECT item_id FROM ph ORDER BY phase, CASE WHEN phase = 0 THEN stratum ELSE '' END, h, item_id LIMIT 150)"""


@query("R6_stratified_sample", W(["measures"], f"WITH {_STRATA} SELECT item_id FROM samp"))
def stratified_sample(spark, d):
    return SA.stratified_sample(B.measures(spark, d), "item_id", _COLS, 150, SEED).select("item_id")


@query(
    "R7_proportional_cap",
    f"""WITH s AS (SELECT l_returnflag, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS t FROM lineitem GROUP BY l_returnflag),
    r AS (SELECT l.*, md5('{SEED}|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey) AS h FROM lineitem l),
    k AS (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY r.l_returnflag ORDER BY h, l_extendedprice) AS i, round_even(10000.0 * n / t, 0) AS target FROM r JOIN s USING (l_returnflag))
    SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (SELECT * FROM k WHERE i <= GREATEST(1, target) ORDER BY h, l_extendedprice LIMIT 10000)""",
)
def proportional_cap(spark, d):
    line = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return SA.proportional_cap(line, "l_returnflag", key, 10000, SEED).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query(
    "R8_item_disjoint_split",
    f"""WITH i AS (SELECT p_partkey, p_size % 3 = 0 AS label, COUNT(*) OVER (PARTITION BY p_size % 3 = 0) AS n, ROW_NUMBER() OVER (PARTITION BY p_size % 3 = 0 ORDER BY md5('{SEED}|' || p_partkey), p_partkey) - 1 AS b FROM part)
    SELECT CASE WHEN b < ROUND(n * 0.25) THEN 'test' ELSE 'train' END AS part, label, COUNT(DISTINCT p_partkey) AS items, COUNT(*) AS rows FROM lineitem JOIN i ON l_partkey = p_partkey GROUP BY ALL""",
)
def item_disjoint_split(spark, d):
    part = B.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 3 == 0).alias("label"))
    lines = B.table(spark, d, "lineitem").select("l_partkey").join(part, "l_partkey")
    split = SP.item_disjoint_split(lines, "l_partkey", "label", 0.25, SEED).drop("label").join(part, "l_partkey")
    return split.groupBy("part", "label").agg(F.countDistinct("l_partkey").alias("items"), F.count("*").alias("rows"))


@query(
    "R9_fixed_audit_sample",
    f"""SELECT lang, doc_id FROM documents QUALIFY ROW_NUMBER() OVER (PARTITION BY lang ORDER BY md5('{SEED}|' || lang || '|' || doc_id), doc_id) <= 40""",
)
def fixed_audit_sample(spark, d):
    docs = B.table(spark, d, "documents").select("lang", "doc_id")
    return SA.hash_top(docs, ["lang"], 40, SEED, ["lang", "doc_id"])


# ---- ranking metrics ------------------------------------------------------------------

MODELS = ["ours", "alpha", "beta"]
SCORES_SQL = f"""{CAND_SQL}, models AS (SELECT unnest(['ours', 'alpha', 'beta']) AS model),
scores AS MATERIALIZED (SELECT model, stage, user_id, item_id, is_target, ({hash_sql("'3|' || model || '|' || user_id || '|' || item_id")} % 50) / 50.0 + CASE WHEN is_target AND model = 'ours' THEN 0.3 ELSE 0 END AS score FROM cand, models)"""
_DISC = "list_sum(list_transform(generate_series(1, {0}), lambda p: 1 / log2(p + 1)))"


def metrics_sql(source: str, keys: str) -> str:
    parts = []
    for k in (10, 20):
        lo, hi = f"LEAST({k}, better)", f"LEAST({k}, better + ties)"
        parts.append(f"GREATEST(0, {hi} - {lo}) / ties AS hr_{k}")
        parts.append(f"(COALESCE({_DISC.format(hi)}, 0) - COALESCE({_DISC.format(lo)}, 0)) / ties AS ndcg_{k}")
    return f"""um AS MATERIALIZED (SELECT {keys}, better, ties AS target_tie_size, n AS candidates, uniq AS unique_scores, sd AS score_sd, {', '.join(parts)} FROM (
      SELECT {keys}, COUNT(*) FILTER (WHERE score > t AND abs(score - t) > 1e-12 + 1e-12 * abs(t)) AS better, COUNT(*) FILTER (WHERE abs(score - t) <= 1e-12 + 1e-12 * abs(t)) AS ties,
      COUNT(*) AS n, COUNT(DISTINCT score) AS uniq, STDDEV_POP(score) AS sd FROM (SELECT *, MAX(score) FILTER (WHERE is_target) OVER (PARTITION BY {keys}) AS t FROM {source}) GROUP BY {keys}))"""


def score_lists(spark, d):
    """All models' scores; lists are shuffled once, by user, and multiplied by the models as they lie then."""
    c = candidates(spark, d).repartition("stage", "user_id").withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    raw = (hash_int(3, "model", "user_id", "item_id") % 50) / 50.0
    bonus = F.when(F.col("is_target") & (F.col("model") == "ours"), 0.3).otherwise(0.0)
    return c.select("model", "stage", "user_id", "item_id", "is_target", (raw + bonus).alias("score"))


def scores(spark, d):
    return stored(score_lists(spark, d))


_UM = metrics_sql("scores", "model, stage, user_id")


@query(
    "REC1_expected_metrics",
    W(
        ["funnel"],
        f"WITH {SCORES_SQL}, {_UM} "
        + sql_rounded("SELECT * FROM um", ["model", "stage", "user_id", "better", "target_tie_size", "candidates", "unique_scores"], ["score_sd", *RK.METRICS]),
    ),
)
def expected_metrics(spark, d):
    return RK.expected_metrics(score_lists(spark, d))


@query(
    "REC2_metric_summary",
    W(
        ["funnel"],
        f"WITH {SCORES_SQL}, {_UM} "
        + sql_rounded(
            "SELECT model, stage, COUNT(*) AS evaluated_users, COUNT(*) FILTER (WHERE target_tie_size > 1) AS target_tied_users, "
            + ", ".join(f"AVG({m}) AS {m}, STDDEV_SAMP({m}) / sqrt(COUNT(*)) AS {m}_se, GREATEST(0, AVG({m}) - 1.96 * STDDEV_SAMP({m}) / sqrt(COUNT(*))) AS {m}_lower" for m in RK.METRICS)
            + " FROM um GROUP BY model, stage",
            ["model", "stage", "evaluated_users", "target_tied_users"],
            [f"{m}{s}" for m in RK.METRICS for s in ("", "_se", "_lower")],
        ),
    ),
)
def metric_summary(spark, d):
    table = RK.metric_summary(RK.expected_metrics(score_lists(spark, d)))
    return table.select("model", "stage", "evaluated_users", "target_tied_users", *[f"{m}{s}" for m in RK.METRICS for s in ("", "_se", "_lower")])


@query(
    "REC3_score_validation",
    W(
        ["funnel"],
        f"""WITH {SCORES_SQL}, g AS (SELECT * FROM scores WHERE NOT (model = 'alpha' AND CAST(item_id AS BIGINT) % 17 = 0)),
        u AS (SELECT s.model, s.user_id, COUNT(*) FILTER (WHERE g.item_id IS NULL) AS miss FROM scores s LEFT JOIN g USING (model, user_id, item_id) GROUP BY 1, 2)
        SELECT model, 'purchase' AS stage, COUNT(*) AS users, CAST(SUM(miss) AS BIGINT) AS missing_scores, 0::BIGINT AS unexpected_scores, 0::BIGINT AS non_finite_scores, 0::BIGINT AS all_tied_users, SUM(miss) = 0 AS passed FROM u GROUP BY model""",
    ),
)
def score_validation(spark, d):
    s = scores(spark, d)
    given = s.filter(~((F.col("model") == "alpha") & (F.col("item_id").cast("bigint") % 17 == 0)))
    wanted = s.filter("model = 'ours'").select("stage", "user_id", "item_id")
    return RK.validate_scores(given, wanted, MODELS)


@query(
    "REC4_multi_positive",
    sql_rounded(
        """WITH t AS (SELECT o_custkey AS u, CAST(l_returnflag = 'N' AS INT) AS y, l_quantity AS s, l_orderkey * 10 + l_linenumber + l_partkey / 1e6 + l_suppkey / 1e9 AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        m AS (SELECT u, SUM(y) AS pos FROM t GROUP BY u HAVING SUM(y) > 0 AND SUM(y) < COUNT(*)), r AS (SELECT t.*, pos, ROW_NUMBER() OVER (PARTITION BY u ORDER BY s DESC, o) AS k FROM t JOIN m USING (u)),
        pu AS (SELECT u, pos, """
        + ", ".join(
            f"MAX(CASE WHEN k <= {k} AND y = 1 THEN 1.0 ELSE 0 END) AS hr_{k}, SUM(CASE WHEN k <= {k} AND y = 1 THEN 1 / log2(k + 1) ELSE 0 END) / list_sum(list_transform(generate_series(1, LEAST({k}, pos)::BIGINT), lambda p: 1 / log2(p + 1))) AS ndcg_{k}"
            for k in (10, 20)
        )
        + " FROM r GROUP BY u, pos) SELECT COUNT(*) AS ranking_users, AVG(hr_10) AS hr_10, AVG(ndcg_10) AS ndcg_10, AVG(hr_20) AS hr_20, AVG(ndcg_20) AS ndcg_20 FROM pu",
        ["ranking_users"],
        ["hr_10", "ndcg_10", "hr_20", "ndcg_20"],
    ),
)
def multi_positive(spark, d):
    line = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_partkey") / 1e6 + F.col("l_suppkey") / 1e9
    t = line.select(F.col("o_custkey").alias("u"), (F.col("l_returnflag") == "N").cast("int").alias("y"), F.col("l_quantity").alias("s"), order.alias("o"))
    return RK.multi_positive_metrics(t, "u", "y", "s", "o")


_PAIRED = """lm AS (SELECT model, stage, user_id, unnest(['hr_10','ndcg_10','hr_20','ndcg_20']) AS metric, unnest([hr_10, ndcg_10, hr_20, ndcg_20]) AS v FROM um),
pd AS (SELECT b.stage, b.metric, b.model AS baseline, COUNT(*) AS paired_users, AVG(a.v - b.v) AS mean_difference, STDDEV_SAMP(a.v - b.v) / sqrt(COUNT(*)) AS paired_se FROM lm b JOIN lm a USING (stage, user_id, metric)
  WHERE a.model = 'ours' AND b.model <> 'ours' GROUP BY ALL)"""


@query(
    "REC6_paired_tests",
    W(
        ["funnel"],
        f"WITH {SCORES_SQL}, {_UM}, {_PAIRED} "
        + sql_rounded(
            "SELECT *, mean_difference - 1.96 * paired_se AS ci_lower, CASE WHEN mean_difference > 0 THEN 'higher' WHEN mean_difference < 0 THEN 'lower' ELSE 'no difference' END AS direction FROM pd",
            ["stage", "metric", "baseline", "paired_users", "direction"],
            ["mean_difference", "paired_se", "ci_lower"],
        ),
    ),
)
def paired_tests(spark, d):
    table = RK.paired_tests(RK.expected_metrics(score_lists(spark, d)), "ours")
    return table.select("stage", "metric", "baseline", "paired_users", "direction", "mean_difference", "paired_se", "ci_lower")


@query(
    "J11_paired_join",
    W(["funnel"], f"WITH {SCORES_SQL}, {_UM} SELECT model, stage, 0::BIGINT AS unmatched_users FROM um WHERE model <> 'ours' GROUP BY model, stage"),
)
def paired_join(spark, d):
    return RK.unmatched_users(RK.expected_metrics(score_lists(spark, d)), "ours")


_SENS = f"""rp AS (SELECT * FROM (VALUES (49, 1), (49, 2), (99, 1)) t(negative_count, replicate)),
nk AS MATERIALIZED (SELECT rp.*, c.stage, c.user_id, c.item_id, ROW_NUMBER() OVER (PARTITION BY rp.negative_count, rp.replicate, c.stage, c.user_id ORDER BY md5('{SEED}|' || rp.replicate || '|' || c.stage || '|' || c.user_id || '|' || c.item_id)) AS k
  FROM cand c, rp WHERE NOT is_target),
sub AS MATERIALIZED (SELECT s.*, nk.negative_count, nk.replicate FROM scores s JOIN nk USING (stage, user_id, item_id) WHERE k <= negative_count UNION ALL SELECT s.*, rp.* FROM scores s, rp WHERE s.is_target)"""
_SENS_RUNS = f"WITH {SCORES_SQL}, {_SENS}, {metrics_sql('sub', 'negative_count, replicate, model, stage, user_id')}"


def sensitivity(spark, d):
    return RK.candidate_sensitivity(score_lists(spark, d), [49, 99], [1, 2], SEED, dealt=True)


@query(
    "REC7_candidate_sensitivity",
    W(
        ["funnel"],
        f"{_SENS_RUNS} "
        + sql_rounded(
            "SELECT model, stage, negative_count, replicate, COUNT(*) AS evaluated_users, AVG(hr_10) AS hr_10, AVG(ndcg_10) AS ndcg_10, AVG(ndcg_20) AS ndcg_20 FROM um GROUP BY ALL",
            ["model", "stage", "negative_count", "replicate", "evaluated_users"],
            ["hr_10", "ndcg_10", "ndcg_20"],
        ),
    ),
)
def candidate_sensitivity(spark, d):
    return sensitivity(spark, d).select("model", "stage", "negative_count", "replicate", "evaluated_users", "hr_10", "ndcg_10", "ndcg_20")


@query(
    "W17_model_ranks",
    W(
        ["funnel"],
        f"""{_SENS_RUNS}, runs AS (SELECT model, stage, negative_count, replicate, AVG(ndcg_10) AS v FROM um GROUP BY ALL), ms AS (SELECT model, stage, negative_count, AVG(v) AS v, MIN(v) AS lo FROM runs GROUP BY ALL)
        SELECT model, stage, negative_count, RANK() OVER (PARTITION BY stage, negative_count ORDER BY v DESC)::INT AS ndcg_rank, ROUND(v, 6) + 0.0 AS ndcg_10_mean, ROUND(lo, 6) + 0.0 AS ndcg_10_min FROM ms""",
    ),
)
def model_ranks(spark, d):
    return RK.sensitivity_summary(sensitivity(spark, d)).select("model", "stage", "negative_count", "ndcg_rank", "ndcg_10_mean", "ndcg_10_min")


_RUNS = "runs AS (SELECT o_orderpriority AS model, year(o_orderdate) % 5 AS seed, 'purchase' AS stage, AVG(o_totalprice) / 1e6 AS ndcg_10 FROM orders GROUP BY ALL)"


@query(
    "REC8_seed_summary",
    f"WITH {_RUNS} "
    + sql_rounded(
        """SELECT stage, model, COUNT(*) AS runs, AVG(ndcg_10) AS ndcg_10_mean, STDDEV_SAMP(ndcg_10) AS ndcg_10_sd, STDDEV_SAMP(ndcg_10) / sqrt(COUNT(*)) AS ndcg_10_se, MIN(ndcg_10) AS ndcg_10_min,
        2.7764451051977987 AS t_critical, AVG(ndcg_10) - 2.7764451051977987 * STDDEV_SAMP(ndcg_10) / sqrt(COUNT(*)) AS ndcg_10_t_lower FROM runs GROUP BY stage, model""",
        ["stage", "model", "runs"],
        ["ndcg_10_mean", "ndcg_10_sd", "ndcg_10_se", "ndcg_10_min", "t_critical", "ndcg_10_t_lower"],
    ),
)
def seed_summary(spark, d):
    runs = B.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model"), (F.year("o_orderdate") % 5).alias("seed")).agg((F.avg("o_totalprice") / 1e6).alias("ndcg_10"))
    table = RK.seed_summary(runs.withColumn("stage", F.lit(STAGE)), ["ndcg_10"])
    return table.select("stage", "model", "runs", "ndcg_10_mean", "ndcg_10_sd", "ndcg_10_se", "ndcg_10_min", "t_critical", "ndcg_10_t_lower")


@query(
    "S9_score_bundles",
    W(["funnel"], f"WITH {SCORES_SQL} " + sql_rounded("SELECT model, stage, user_id, item_id, score FROM scores", ["model", "stage", "user_id", "item_id"], ["score"])),
)
def score_bundles(spark, d):
    return RK.read_score_bundles(RK.score_bundles(score_lists(spark, d)))


# ---- re-ranking -------------------------------------------------------------------------

_LEVELS = f"""{PRIOR_SQL}, {SPLIT_SQL}, x AS MATERIALIZED (SELECT p.*, ln(1 + events_pre) AS v FROM parted p JOIN prior q ON p.user_id = q.user_id AND p."timestamp" = q."timestamp"),
cuts AS (SELECT quantile_cont(v, 1.0/3) AS c1, quantile_cont(v, 2.0/3) AS c2 FROM x WHERE split IN ('A', 'B') AND v > 0),
lv AS (SELECT user_id, CASE WHEN v <= 0 THEN 0 ELSE 1 + CAST(v >= c1 AS INT) + CAST(v >= c2 AS INT) END AS level FROM (SELECT user_id, ln(1 + COUNT(*)) AS v FROM x WHERE split IN ('A', 'B') GROUP BY user_id), cuts)"""


def levelled(spark, d):
    out = H.prior_counts(B.funnel(spark, d), "user_id", "timestamp", {})
    out = SP.temporal_split(out, "timestamp")
    train = out.filter(F.col("split").isin("A", "B"))
    cuts = R.history_cuts(train, "user_events_pre_log")
    return out.withColumn("H_level", R.history_level("user_events_pre_log", cuts)), cuts


@query("A23_end_of_window_levels", W(["funnel"], f"WITH {_LEVELS} SELECT * FROM lv"))
def end_of_window_levels(spark, d):
    out, cuts = levelled(spark, d)
    return RC.end_of_window_levels(out.filter(F.col("split").isin("A", "B")), cuts)


@query(
    "A24_state_audit",
    W(
        ["funnel"],
        f"""WITH {_LEVELS}, old AS (SELECT user_id, CASE WHEN v <= 0 THEN 0 ELSE 1 + CAST(v >= c1 AS INT) + CAST(v >= c2 AS INT) END AS o FROM x, cuts WHERE split IN ('A', 'B')
          QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, item_id DESC) = 1),
        cu AS (SELECT DISTINCT user_id FROM parted WHERE split = 'C' AND y_purchase = 1), j AS (SELECT COALESCE(level, 0) AS n, COALESCE(o, 0) AS o FROM cu LEFT JOIN lv USING (user_id) LEFT JOIN old USING (user_id))
        SELECT 'purchase' AS stage, COUNT(*) AS candidate_users, COUNT(*) FILTER (WHERE o = 0) AS legacy_h0_users, COUNT(*) FILTER (WHERE n <> o) AS state_mismatch_users, ROUND(AVG((n <> o)::INT), 6) + 0.0 AS state_mismatch_rate,
        COUNT(*) FILTER (WHERE n = 0) AS corrected_h0_users, COUNT(*) FILTER (WHERE n = 1) AS corrected_h1_users, COUNT(*) FILTER (WHERE n = 2) AS corrected_h2_users, COUNT(*) FILTER (WHERE n = 3) AS corrected_h3_users FROM j""",
    ),
)
def state_audit(spark, d):
    out, cuts = levelled(spark, d)
    train = out.filter(F.col("split").isin("A", "B"))
    users = out.filter("split = 'C' AND y_purchase = 1").select(F.lit(STAGE).alias("stage"), "user_id")
    return RC.state_audit(users, RC.end_of_window_levels(train, cuts), RC.last_row_levels(train, "timestamp", "H_level"))


@query(
    "A25_semantic_alignment",
    W(
        ["funnel", "items"],
        f"""WITH {CAND_SQL}, cl AS (SELECT user_id, category, COUNT(*) AS c FROM set_b JOIN items USING (item_id) WHERE y_click = 1 GROUP BY ALL), tt AS (SELECT user_id, SUM(c) AS t FROM cl GROUP BY user_id)
        SELECT cand.user_id, cand.item_id, ROUND(COALESCE(COALESCE(c, 0) / t, 0), 6) + 0.0 AS t_int_sem FROM cand JOIN items USING (item_id) LEFT JOIN tt USING (user_id) LEFT JOIN cl ON cl.user_id = cand.user_id AND cl.category = items.category""",
    ),
)
def semantic_alignment(spark, d):
    b, c = set_b_c(spark, d)
    categories = B.items(spark, d).select("item_id", "category")
    totals, by_category = RC.semantic_history(b, categories)
    lists = CA.stage_candidates(b, c, STAGE, NEGATIVES, SEED).drop("category")
    return RC.add_alignment(lists, categories, totals, by_category).select("user_id", "item_id", F.col("T_int_sem").alias("t_int_sem"))


@query(
    "A26_item_profiles",
    """WITH v AS (SELECT l_partkey % 400 AS k, l_discount, CASE WHEN l_linenumber % 4 > 0 THEN l_tax END AS l_tax, l_shipdate, l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_partkey % 400 < 300),
    med AS (SELECT MEDIAN(l_discount) AS a, MEDIAN(l_tax) AS b FROM v), la AS (SELECT k, COALESCE(l_discount, a) AS x, COALESCE(l_tax, b) AS y FROM v, med QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1),
    s AS (SELECT AVG(x) AS mx, STDDEV_POP(x) AS sx, AVG(y) AS my, STDDEV_POP(y) AS sy FROM la)
    SELECT i.k AS item_id, ROUND(COALESCE(x, 0), 6) + 0.0 AS l_discount, ROUND(COALESCE((x - mx) / sx, 0), 6) + 0.0 AS l_discount_z, ROUND(COALESCE(y, 0), 6) + 0.0 AS l_tax, ROUND(COALESCE((y - my) / sy, 0), 6) + 0.0 AS l_tax_z
    FROM (SELECT DISTINCT p_partkey % 400 AS k FROM part) i LEFT JOIN la USING (k), s""",
)
def item_profiles(spark, d):
    k = F.col("l_partkey") % 400
    v = B.table(spark, d, "lineitem").filter(k < 300).select(
        k.alias("item_id"), "l_discount", F.when(F.col("l_linenumber") % 4 > 0, F.col("l_tax")).alias("l_tax"), "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    items = B.table(spark, d, "part").select((F.col("p_partkey") % 400).alias("item_id"))
    return RC.item_profiles(v, items, ["l_discount", "l_tax"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"])


@query(
    "A26_scaled_features",
    """WITH f AS (SELECT vec_id AS item_id, embedding[1]::DOUBLE AS e0, CASE WHEN label > 0 THEN embedding[2]::DOUBLE ELSE 0 END AS e1 FROM embeddings)
    SELECT item_id, ROUND((e0 - AVG(e0) OVER ()) / STDDEV_POP(e0) OVER (), 6) + 0.0 AS e0, ROUND((e1 - AVG(e1) OVER ()) / STDDEV_POP(e1) OVER (), 6) + 0.0 AS e1 FROM f""",
)
def scaled_features(spark, d):
    e = B.table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("item_id"), F.col("embedding")[0].cast("double").alias("e0"), F.when(F.col("label") > 0, F.col("embedding")[1].cast("double")).alias("e1"))
    return RC.scaled_features(v, v, ["e0", "e1"])


def relevance_table(spark, d):
    """Candidates with a relevance and a causal score."""
    c = candidates(spark, d)
    m = B.measures(spark, d).select("item_id", "T_int_fac", "T_con_mkt")
    causal = 0.2 * F.col("T_int_fac") - 0.1 * F.col("T_con_mkt")
    rel = (hash_int(4, "user_id", "item_id") % 1000) / 1000.0 + F.when(F.col("is_target"), 0.4).otherwise(0.0)
    return stored(c.join(m, "item_id").select("stage", "user_id", "item_id", "is_target", rel.alias("relevance"), causal.alias("causal")))


_REL = f"""rel AS MATERIALIZED (SELECT stage, user_id, item_id, is_target, ({hash_sql("'4|' || user_id || '|' || item_id")} % 1000) / 1000.0 + CASE WHEN is_target THEN 0.4 ELSE 0 END AS relevance,
  0.2 * T_int_fac - 0.1 * T_con_mkt AS causal FROM cand JOIN measures USING (item_id)),
cal AS (SELECT AVG(relevance) AS rm, STDDEV_POP(relevance) AS rs, AVG(causal) AS cm, STDDEV_POP(causal) AS cs, COUNT(*) AS pairs FROM rel)"""


@query(
    "REC10_calibrated_blend",
    W(
        ["funnel", "measures"],
        f"WITH {CAND_SQL}, {_REL} " + sql_rounded("SELECT user_id, item_id, (relevance - rm) / rs + 0.5 * (causal - cm) / cs AS score FROM rel, cal", ["user_id", "item_id"], ["score"], 5),
    ),
)
def calibrated_blend(spark, d):
    t = relevance_table(spark, d)
    return RC.blend(t, RC.calibration(t), F.lit(0.5)).select("user_id", "item_id", F.round("score", 5).alias("score"))


@query(
    "REC10_score_calibration",
    W(
        ["funnel", "measures"],
        f"WITH {CAND_SQL}, {_REL} " + sql_rounded("SELECT 'purchase' AS stage, pairs, rm AS relevance_mean, rs AS relevance_sd, cm AS causal_mean, cs AS causal_sd FROM cal", ["stage", "pairs"], ["relevance_mean", "relevance_sd", "causal_mean", "causal_sd"]),
    ),
)
def score_calibration(spark, d):
    return RC.calibration(relevance_table(spark, d))


@query(
    "REC11_weight_selection",
    W(
        ["funnel", "measures"],
        f"""WITH {CAND_SQL}, {_REL}, grid AS (SELECT unnest([0.0, 0.25, 0.5, 1.0]::DOUBLE[]) AS weight),
        rr AS MATERIALIZED (SELECT weight, stage, user_id, item_id, is_target, causal, (relevance - rm) / rs + weight * (causal - cm) / cs AS score FROM rel, cal, grid), {metrics_sql('rr', 'weight, stage, user_id')},
        ut AS (SELECT weight, user_id, SUM(causal / log2(k + 1)) / SUM(1 / log2(k + 1)) AS u FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY weight, user_id ORDER BY score DESC, is_target, item_id) AS k FROM rr) WHERE k <= 10 GROUP BY ALL) """
        + sql_rounded(
            "SELECT um.weight, COUNT(*) AS validation_users, AVG(um.ndcg_10) AS ndcg_10, AVG(u) AS mean_causal_score, AVG(um.ndcg_10 - b.ndcg_10) AS ndcg_difference FROM um JOIN ut USING (weight, user_id) JOIN um b ON b.weight = 0 AND b.user_id = um.user_id GROUP BY um.weight",
            ["weight", "validation_users"],
            ["ndcg_10", "mean_causal_score", "ndcg_difference"],
            5,
        ),
    ),
)
def weight_selection(spark, d):
    t = relevance_table(spark, d)
    gates = spark.createDataFrame([(STAGE, True)], "stage string, gate_passed boolean")
    table = RC.select_weight(t, RC.calibration(t), [0.0, 0.25, 0.5, 1.0], gates, 0.95)
    return table.select("weight", "validation_users", *[F.round(c, 5).alias(c) for c in ("ndcg_10", "mean_causal_score", "ndcg_difference")])


@query("REC11_selected_weight")
def selected_weight(spark, d):
    t = relevance_table(spark, d)
    gates = spark.createDataFrame([(STAGE, True)], "stage string, gate_passed boolean")
    return RC.select_weight(t, RC.calibration(t), [0.0, 0.25, 0.5, 1.0], gates, 0.95)


@query("E31_causal_prior")
def causal_prior(spark, d):
    return RC.causal_prior(residuals(spark, d), OUTCOMES, HEURISTIC, ANALYTICAL)


@query("E32_prior_stability")
def prior_stability(spark, d):
    return RC.prior_stability(residuals(spark, d), "timestamp", OUTCOMES, HEURISTIC, ANALYTICAL, 0.5, 0.0)


_PRIOR_ROWS = [("purchase", "ALL", "T_con_mkt", 0.3), ("purchase", "ALL", "T_int_fac", -0.2), ("purchase", "2", "T_con_mkt", 0.5), ("purchase", "2", "T_int_fac", 0.1)]


@query(
    "REC9_candidate_scores",
    W(
        ["funnel", "measures"],
        f"""WITH {CAND_SQL} SELECT user_id, item_id, ROUND(CASE WHEN CAST(user_id AS BIGINT) % 4 = 2 THEN 0.5 * T_con_mkt + 0.1 * T_int_fac ELSE 0.3 * T_con_mkt - 0.2 * T_int_fac END, 6) + 0.0 AS causal FROM cand JOIN measures USING (item_id)""",
    ),
)
def candidate_scores(spark, d):
    prior = spark.createDataFrame(_PRIOR_ROWS, "stage string, h_level string, component string, coefficient double")
    levels = B.users(spark, d).select("user_id", (F.col("user_id").cast("bigint") % 4).cast("int").alias("level"))
    profiles = B.measures(spark, d).select("item_id", "T_con_mkt", "T_int_fac")
    return RC.candidate_scores(candidates(spark, d), profiles, levels, prior, ["T_con_mkt", "T_int_fac"]).select("user_id", "item_id", "causal")


_POLICY_SQL = """ev AS MATERIALIZED (SELECT f.*, T_con_mkt, T_int_fac FROM funnel f JOIN measures USING (item_id) WHERE user_id IN (SELECT user_id FROM funnel GROUP BY user_id HAVING COUNT(*) >= 3)),
sc AS (SELECT *, 0.3 * T_con_mkt - 0.2 * T_int_fac AS s1, 0.1 * T_con_mkt + 0.4 * T_int_fac AS s2 FROM ev),
p1 AS (SELECT * FROM sc QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY s1 DESC, item_id, "timestamp") = 1), p2 AS (SELECT * FROM sc QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY s2 DESC, item_id, "timestamp") = 1)"""


@query(
    "REC12_policy_table",
    W(
        ["funnel", "measures"],
        f"WITH {_POLICY_SQL} "
        + sql_rounded(
            " UNION ALL ".join(
                f"SELECT '{n}' AS policy, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT item_id) AS items, AVG(y_click) * 100 AS click_rate, AVG(y_cart) * 100 AS cart_rate, AVG(y_purchase) * 100 AS purchase_rate, AVG(0.3 * T_con_mkt - 0.2 * T_int_fac) AS mean_lift, (SELECT COUNT(*) FROM ev) AS candidate_rows FROM {p}"
                for n, p in (("static", "p1"), ("other", "p2"))
            ),
            ["policy", "users", "items", "candidate_rows"],
            ["click_rate", "cart_rate", "purchase_rate", "mean_lift"],
            5,
        ),
    ),
)
def policy_table(spark, d):
    events = B.funnel(spark, d).join(B.measures(spark, d).select("item_id", "T_con_mkt", "T_int_fac"), "item_id")
    policies = {"static": RC.lift({"T_con_mkt": 0.3, "T_int_fac": -0.2}), "other": RC.lift({"T_con_mkt": 0.1, "T_int_fac": 0.4})}
    table = RC.policy_table(events, policies, {"T_con_mkt": (0.3, 0.05), "T_int_fac": (-0.2, 0.05)}, reference="static")
    return table.select("policy", "users", "items", "candidate_rows", *[F.round(c, 5).alias(c) for c in ("click_rate", "cart_rate", "purchase_rate", "mean_lift")])


# ---- the same steps on the estimated prior ----------------------------------------------------


def reranked(spark, d):
    """Prior, gate and weight from the residuals; users' levels and items' treatments from the tables."""
    r = residuals(spark, d)
    means = [F.avg(c).alias(E.component(c)) for c in [*HEURISTIC, *ANALYTICAL]]
    profiles = r.groupBy("item_id").agg(*means)
    levels = r.groupBy("user_id").agg(F.max("H_level").alias("level"))
    rel = (hash_int(4, "user_id", "item_id") % 1000) / 1000.0 + F.when(F.col("is_target"), 0.4).otherwise(0.0)
    given = candidates(spark, d).select("stage", "user_id", "item_id", "is_target", rel.alias("relevance"))
    return RC.estimated_reranking(given, profiles, levels, r, OUTCOMES, HEURISTIC, ANALYTICAL, "timestamp", [0.0, 0.25, 0.5, 1.0], 0.95, 0.5, 0.0)


@query("REC9_estimated_reranking")
def estimated_reranking(spark, d):
    return reranked(spark, d)[0]


@query("REC11_estimated_weights")
def estimated_weights(spark, d):
    return reranked(spark, d)[3]


@query("REC12_estimated_policies")
def estimated_policies(spark, d):
    """Policies by the estimated coefficients of each stage, valued by those of the purchase stage."""
    r = residuals(spark, d)
    cues = [*HEURISTIC, *ANALYTICAL]
    effects = cut(E.family(r, OUTCOMES, cues).filter("estimable AND coefficient IS NOT NULL"))
    parameters = effects.select(F.concat(F.lit("by_"), "stage").alias("policy"), "treatment", "coefficient")
    theta = effects.filter("stage = 'purchase'").select("treatment", "coefficient", "std_error")
    keys = ["user_id", "item_id", "timestamp"]
    flags = B.funnel(spark, d).select(*keys, "y_click", "y_cart", "y_purchase")
    rows = r.select(*keys, *cues).join(flags, keys)
    return RC.estimated_policies(rows, parameters, theta, cues)


@query("R14_lift_interval")
def lift_interval(spark, d):
    events = B.measures(spark, d)
    mean, low, high = RC.lift_interval(events, {"T_con_mkt": (0.3, 0.05), "T_int_fac": (-0.2, 0.05)})
    return E.small_frame(spark, [(mean, low, high, low < mean < high)], "mean_lift double, lift_lower double, lift_upper double, ordered boolean")


# ---- agreement ----------------------------------------------------------------------------

CODES = ["T_con_mkt", "T_int_vis", "T_int_fac"]
RATERS = ["R1", "R2", "R3"]
_GRADED = f"""graded AS MATERIALIZED (SELECT 'd' || (p_partkey % 2) AS dataset, CAST(p_partkey AS VARCHAR) AS item_id, c.code AS construct_code, 'R' || r.r AS rater_id,
  ((p_partkey * 7919 + c.i * 104729) % 11 + (p_partkey * r.r + c.i) % 4)::DOUBLE * 10 / 13 AS score FROM part, (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(CODES))}) c(i, code), range(1, 4) r(r))"""


def graded(spark, d):
    """Three raters' scores per item and construct."""
    codes = spark.createDataFrame(list(enumerate(CODES)), "i int, construct_code string")
    raters = spark.createDataFrame([(1,), (2,), (3,)], "r int")
    t = spread(B.table(spark, d, "part").select("p_partkey"), "p_partkey").crossJoin(F.broadcast(codes)).crossJoin(F.broadcast(raters))
    k = F.col("p_partkey")
    score = ((k * 7919 + F.col("i") * 104729) % 11 + (k * F.col("r") + F.col("i")) % 4).cast("double") * 10 / 13
    return t.select(
        F.concat(F.lit("d"), (k % 2).cast("string")).alias("dataset"), k.cast("string").alias("item_id"), "construct_code",
        F.concat(F.lit("R"), F.col("r").cast("string")).alias("rater_id"), score.alias("score"),
    )


def rater_pairs(spark, d):
    g = graded(spark, d)
    keys = ["dataset", "item_id", "construct_code"]
    a = g.filter("rater_id = 'R1'").select(*keys, F.col("score").alias("a"))
    return a.join(g.filter("rater_id = 'R2'").select(*keys, F.col("score").alias("b")), keys)


_PAIRS = "pr AS MATERIALIZED (SELECT a.dataset, a.item_id, a.construct_code, a.score AS a, b.score AS b FROM graded a JOIN graded b USING (dataset, item_id, construct_code) WHERE a.rater_id = 'R1' AND b.rater_id = 'R2')"
_BY = ["dataset", "construct_code"]


def ranks_sql(column: str, out: str) -> str:
    return f"RANK() OVER (PARTITION BY dataset, construct_code ORDER BY {column}) + (COUNT(*) OVER (PARTITION BY dataset, construct_code, {column}) - 1) / 2.0 AS {out}"


_QWK = "1 - AVG(pow(round_even(a, 0) - round_even(b, 0), 2)) / (AVG(pow(round_even(a, 0), 2)) + AVG(pow(round_even(b, 0), 2)) - 2 * AVG(round_even(a, 0)) * AVG(round_even(b, 0)))"


@query(
    "G1_wide_to_long",
    W(["measures"], "WITH t AS (SELECT 'd' AS dataset, item_id, 'm' AS model_id, CAST(item_id AS BIGINT) % 5 <> 0 AS schema_valid, " + ", ".join(f"{c} * 10 AS {c}" for c in CODES) + " FROM measures) "
      + " UNION ALL ".join(f"SELECT dataset, item_id, model_id, schema_valid, '{c}' AS construct_code, ROUND({c}, 6) + 0.0 AS score FROM t" for c in CODES)),
)
def wide_to_long(spark, d):
    m = B.measures(spark, d)
    valid = F.when(F.col("item_id").cast("bigint") % 5 != 0, "Yes").otherwise("no")
    wide = m.select(F.lit("d").alias("dataset"), "item_id", F.lit("m").alias("model_id"), valid.alias("schema_valid"), *[(F.col(c) * 10).alias(f"{c}_0_10") for c in CODES])
    return AG.wide_to_long(wide, CODES)


@query(
    "G1_json_to_long",
    W(["measures"], " UNION ALL ".join(f"SELECT 'd' AS dataset, item_id, 'm' AS model_id, TRUE AS schema_valid, '{c}' AS construct_code, " + (f"CASE WHEN CAST(item_id AS BIGINT) % 3 = 0 THEN NULL ELSE ROUND({c}, 6) + 0.0 END" if c == "T_int_vis" else f"ROUND({c}, 6) + 0.0") + " AS score FROM measures" for c in CODES)),
)
def json_to_long(spark, d):
    m = B.measures(spark, d)
    vis = F.when(F.col("item_id").cast("bigint") % 3 != 0, F.col("T_int_vis"))
    inner = F.struct("T_con_mkt", vis.alias("T_int_vis"), "T_int_fac")
    plain = F.to_json(F.struct(F.lit("d").alias("dataset"), "item_id", F.lit("m").alias("model_id"), inner.alias("scores")))
    other = F.to_json(F.struct(F.lit("d").alias("dataset"), "item_id", F.lit("m").alias("model_id"), F.lit(True).alias("schema_valid"), inner.alias("mcre_scores")))
    lines = m.select(F.when(F.col("item_id").cast("bigint") % 2 == 0, plain).otherwise(other).alias("value"))
    return AG.json_to_long(lines, CODES)


@query(
    "G2_consensus",
    f"WITH {_GRADED} SELECT dataset, item_id, construct_code, ROUND(MEDIAN(score), 6) + 0.0 AS median_score FROM graded GROUP BY ALL",
)
def consensus(spark, d):
    return AG.consensus(graded(spark, d))


@query(
    "G2_complete_cases",
    f"""WITH {_GRADED} SELECT dataset, construct_code, item_id, ROUND(MAX(score) FILTER (WHERE rater_id = 'R1'), 6) + 0.0 AS "R1", ROUND(MAX(score) FILTER (WHERE rater_id = 'R2'), 6) + 0.0 AS "R2", ROUND(MAX(score) FILTER (WHERE rater_id = 'R3'), 6) + 0.0 AS "R3"
    FROM graded WHERE NOT (rater_id = 'R3' AND CAST(item_id AS BIGINT) % 6 = 0) GROUP BY ALL HAVING COUNT(*) = 3""",
)
def complete_cases(spark, d):
    g = graded(spark, d).filter(~((F.col("rater_id") == "R3") & (F.col("item_id").cast("bigint") % 6 == 0)))
    return AG.complete_cases(g, RATERS)


@query("G3_weighted_kappa", f"WITH {_GRADED}, {_PAIRS} SELECT dataset, construct_code, ROUND({_QWK}, 6) + 0.0 AS weighted_kappa FROM pr GROUP BY ALL")
def weighted_kappa(spark, d):
    return rater_pairs(spark, d).groupBy(*_BY).agg(AG.weighted_kappa(F.col("a"), F.col("b")).alias("weighted_kappa"))


@query(
    "G4_binary_kappa",
    sql_rounded(
        "SELECT n, agree, (agree - e) / (1 - e) AS kappa FROM (SELECT COUNT(*) AS n, AVG((quality = toxic)::INT) AS agree, AVG(quality) * AVG(toxic) + (1 - AVG(quality)) * (1 - AVG(toxic)) AS e FROM labels)",
        ["n"],
        ["agree", "kappa"],
    ),
)
def binary_kappa(spark, d):
    t = B.table(spark, d, "labels")
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    return t.agg(F.count("*").alias("n"), F.avg((a == b).cast("double")).alias("agree"), AG.binary_kappa(a, b).alias("kappa"))


@query(
    "G5_correlations",
    f"""WITH {_GRADED}, {_PAIRS}, rk AS (SELECT dataset, construct_code, a, b, {ranks_sql('a', 'ra')}, {ranks_sql('b', 'rb')} FROM pr)
    SELECT dataset, construct_code, ROUND(corr(ra, rb), 6) + 0.0 AS spearman, ROUND(corr(a, b), 6) + 0.0 AS pearson FROM rk GROUP BY ALL""",
)
def correlations(spark, d):
    p = rater_pairs(spark, d)
    return AG.spearman(p, "a", "b", _BY).join(p.groupBy(*_BY).agg(F.corr("a", "b").alias("pearson")), _BY)


@query(
    "G6_agreement_bundle",
    f"""WITH RECURSIVE {_GRADED}, {_PAIRS}, rk AS (SELECT *, {ranks_sql('a', 'ra')}, {ranks_sql('b', 'rb')}, COUNT(*) OVER (PARTITION BY dataset, construct_code) AS n FROM pr),
    tt AS (SELECT *, CASE WHEN ra / n <= 1/3 THEN 0 WHEN ra / n <= 2/3 THEN 1 ELSE 2 END AS ta, CASE WHEN rb / n <= 1/3 THEN 0 WHEN rb / n <= 2/3 THEN 1 ELSE 2 END AS tb FROM rk) """
    + sql_rounded(
        f"""SELECT dataset, construct_code, COUNT(*) AS n_compared, corr(ra, rb) AS spearman, corr(a, b) AS pearson, AVG(abs(a - b)) AS mae, {_QWK} AS weighted_kappa, AVG((ta = tb)::INT) AS tertile_agreement,
        AVG((abs(a - b) >= 2.5)::INT) AS large_error_rate, AVG(((a > 0) = (b > 0))::INT) AS presence_agreement, AVG((a > 0)::INT) AS left_nonzero_rate, AVG((b > 0)::INT) AS right_nonzero_rate,
        (AVG(((a > 0) = (b > 0))::INT) - (AVG((a > 0)::INT) * AVG((b > 0)::INT) + (1 - AVG((a > 0)::INT)) * (1 - AVG((b > 0)::INT)))) / NULLIF(1 - (AVG((a > 0)::INT) * AVG((b > 0)::INT) + (1 - AVG((a > 0)::INT)) * (1 - AVG((b > 0)::INT))), 0) AS presence_kappa
        FROM tt GROUP BY dataset, construct_code""",
        ["dataset", "construct_code", "n_compared"],
        ["spearman", "pearson", "mae", "weighted_kappa", "tertile_agreement", "large_error_rate", "presence_agreement", "left_nonzero_rate", "right_nonzero_rate", "presence_kappa"],
    ),
)
def agreement_bundle(spark, d):
    return AG.bundle(rater_pairs(spark, d), "a", "b", _BY)


_ICC = """ic AS (SELECT dataset, construct_code, COUNT(*) AS m, AVG(score) AS g, SUM(score * score) AS ss FROM graded GROUP BY ALL), ri AS (SELECT dataset, construct_code, COUNT(*) AS n, SUM(x * x) AS rs FROM (SELECT dataset, construct_code, item_id, AVG(score) AS x FROM graded GROUP BY ALL) GROUP BY ALL),
rr AS (SELECT dataset, construct_code, COUNT(*) AS k, SUM(x * x) AS cs FROM (SELECT dataset, construct_code, rater_id, AVG(score) AS x FROM graded GROUP BY ALL) GROUP BY ALL),
an AS (SELECT dataset, construct_code, n, k, (k * rs - n * k * g * g) / (n - 1) AS msr, (n * cs - n * k * g * g) / (k - 1) AS msc, (ss - n * k * g * g - (k * rs - n * k * g * g) - (n * cs - n * k * g * g)) / ((n - 1) * (k - 1)) AS mse FROM ic JOIN ri USING (dataset, construct_code) JOIN rr USING (dataset, construct_code))"""


@query("G7_icc", f"WITH {_GRADED}, {_ICC} SELECT dataset, construct_code, n AS complete_items, ROUND((msr - mse) / (msr + (msc - mse) / n), 6) + 0.0 AS icc_2k FROM an")
def icc(spark, d):
    return AG.icc2k(graded(spark, d), _BY)


@query(
    "G7_pairwise_kappa",
    f"""WITH {_GRADED}, pk AS (SELECT x.dataset, x.construct_code, x.rater_id AS r1, y.rater_id AS r2, {_QWK.replace('(a,', '(x.score,').replace('(b,', '(y.score,')} AS k FROM graded x JOIN graded y USING (dataset, item_id, construct_code) WHERE x.rater_id < y.rater_id GROUP BY ALL)
    SELECT dataset, construct_code, ROUND(AVG(k), 6) + 0.0 AS mean_pairwise_kappa FROM pk GROUP BY ALL""",
)
def pairwise_kappa(spark, d):
    return AG.pairwise_kappa(AG.complete_cases(graded(spark, d), RATERS), RATERS, _BY)


@query("G8_failure_cases", f"WITH {_GRADED}, {_PAIRS} SELECT dataset, item_id, construct_code, ROUND(abs(a - b), 6) + 0.0 AS absolute_error FROM pr WHERE abs(a - b) >= 2.0")
def failure_cases(spark, d):
    return AG.failure_cases(rater_pairs(spark, d), "a", "b", 2.0).select("dataset", "item_id", "construct_code", "absolute_error")


@query(
    "G8_dataset_range",
    f"""WITH {_GRADED}, {_PAIRS}, s AS (SELECT dataset, construct_code, AVG(abs(a - b)) AS mae, corr(a, b) AS pearson FROM pr GROUP BY ALL)
    SELECT dataset, COUNT(DISTINCT construct_code) AS validated_treatments, ROUND(MIN(mae), 6) + 0.0 AS mae_min, ROUND(MAX(mae), 6) + 0.0 AS mae_max, ROUND(MIN(pearson), 6) + 0.0 AS pearson_min, ROUND(MAX(pearson), 6) + 0.0 AS pearson_max FROM s GROUP BY dataset""",
)
def dataset_range(spark, d):
    p = rater_pairs(spark, d)
    summary = p.groupBy(*_BY).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.corr("a", "b").alias("pearson"))
    return AG.dataset_range(summary, {"mae": "mae", "pearson": "pearson"})


@query("G9_combine_raters", f"WITH {_GRADED} SELECT rater_id, COUNT(*) AS rows, ROUND(SUM(score), 4) + 0.0 AS total FROM graded GROUP BY rater_id")
def combine_raters(spark, d):
    g = graded(spark, d)
    merged = AG.combine_raters([g.filter(F.col("rater_id") == r) for r in RATERS], RATERS)
    return merged.groupBy("rater_id").agg(F.count("*").alias("rows"), F.round(F.sum("score"), 4).alias("total"))


@query(
    "G10_annotation_template",
    W(["measures"], f"""WITH {_STRATA} SELECT s.item_id, c.code AS construct_code, r.rater_id, r.rater_role FROM samp s, (VALUES {', '.join(f"('{c}')" for c in _COLS)}) c(code), (VALUES ('R1', 'expert'), ('R2', 'reviewer')) r(rater_id, rater_role)"""),
)
def annotation_template(spark, d):
    blank, _ = AG.annotation_template(B.measures(spark, d), _COLS, {"R1": "expert", "R2": "reviewer"}, 150, SEED)
    return blank.select("item_id", "construct_code", "rater_id", "rater_role")


@query(
    "A21_availability",
    W(
        ["measures"],
        "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS construct_code, CASE WHEN CAST(item_id AS BIGINT) % 8 = 0 THEN NULL ELSE {c} END AS v FROM measures" for c in CODES) + ") "
        + sql_rounded(
            "SELECT construct_code, COUNT(*) AS source_rows, COUNT(v) AS observed_items, AVG((v IS NOT NULL)::INT) AS available_rate, COUNT(*) FILTER (WHERE v = 0) AS zero_items, AVG(COALESCE((v = 0)::INT, 0)) AS exact_zero_rate, AVG((v = 0)::INT) AS zero_share_of_observed FROM l GROUP BY construct_code",
            ["construct_code", "source_rows", "observed_items", "zero_items"],
            ["available_rate", "exact_zero_rate", "zero_share_of_observed"],
        ),
    ),
)
def availability(spark, d):
    m = B.measures(spark, d)
    gap = m.select(*[F.when(F.col("item_id").cast("bigint") % 8 != 0, F.col(c)).alias(c) for c in CODES])
    return AG.availability(gap, CODES)


@query(
    "J12_reference_coverage",
    "SELECT COUNT(*) * 3 AS expected_rows, COUNT(*) FILTER (WHERE p_partkey % 20 = 0) * 3 AS missing_scores FROM part",
)
def reference_coverage(spark, d):
    context = B.items(spark, d).select("item_id")
    long = O.melt(B.measures(spark, d).filter(F.col("item_id").cast("bigint") % 20 != 0), CODES, ["item_id"], "construct_code", "score")
    return AG.reference_coverage(context, long, ["item_id"], "score", 3)


_RANK_SEED, _RANK_DRAWS = 20260728, 999


@query(
    "R15_rank_permutation",
    f"""WITH RECURSIVE {_GRADED}, {_PAIRS}, rk AS (SELECT *, {ranks_sql('a', 'ra')}, {ranks_sql('b', 'rb')}, COUNT(*) OVER (PARTITION BY dataset, construct_code) AS n FROM pr),
    ce AS MATERIALIZED (SELECT dataset, construct_code, ra - (n + 1) / 2.0 AS x, rb - (n + 1) / 2.0 AS y, n, ROW_NUMBER() OVER (ORDER BY dataset, construct_code, item_id) - 1 AS pos FROM rk),
    act AS (SELECT dataset, construct_code, COUNT(*) AS items, SUM(x * y) AS xy, sqrt(SUM(x * x) * SUM(y * y)) AS scale FROM ce GROUP BY ALL),
    src AS MATERIALIZED (SELECT r.rep, pos, MIN(pos) OVER (PARTITION BY dataset, construct_code, r.rep) AS start, n::BIGINT AS n FROM ce, range(1, {_RANK_DRAWS + 1}) r(rep)),
    {", ".join(Q.permuted_ctes("pm", "src", _RANK_SEED))},
    draw AS (SELECT c.dataset, c.construct_code, pm.rep, SUM(m.x * c.y) AS v FROM pm JOIN ce m ON pm.pos = m.pos JOIN ce c ON pm.v = c.pos GROUP BY ALL),
    hit AS (SELECT dataset, construct_code, COUNT(*) FILTER (WHERE abs(v) >= abs(xy) - 1e-9 * scale) AS hits FROM draw JOIN act USING (dataset, construct_code) GROUP BY ALL) """
    + sql_rounded(
        f"SELECT dataset, construct_code, items, CASE WHEN scale > 0 THEN xy / scale END AS spearman_rho, CASE WHEN scale > 0 THEN (1 + hits) / {_RANK_DRAWS + 1}.0 END AS spearman_p FROM act JOIN hit USING (dataset, construct_code)",
        ["dataset", "construct_code", "items"],
        ["spearman_rho", "spearman_p"],
    ),
)
def rank_permutation(spark, d):
    return AG.spearman_permutation(rater_pairs(spark, d), "a", "b", _BY, "item_id", _RANK_DRAWS, _RANK_SEED)
