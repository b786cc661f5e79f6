"""Queries: joins, history features, ranks, splits and dimension tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelweir.operators import describe as D
from funnelweir.operators import history as H
from funnelweir.operators import ordering as O
from funnelweir.operators import quality as Q
from funnelweir.operators import ranks as R
from funnelweir.operators import recommend as RC
from funnelweir.operators import splits as SP
from funnelweir.plans import master as M
from funnelweir.plans import tables as B
from funnelweir.plans.registry import query, sql_rounded
from funnelweir.session import stored

W = B.sql_with
EVENT = ["user_id", "item_id", '"timestamp"']

# ---- SQL fragments -----------------------------------------------------------

PRIOR_SQL = """t AS (SELECT user_id, "timestamp", COUNT(*) AS e, SUM(y_click) AS c, SUM(y_cart) AS b, SUM(y_purchase) AS p
  FROM funnel GROUP BY ALL),
prior AS (SELECT user_id, "timestamp", COALESCE(SUM(e) OVER w, 0) AS events_pre, COALESCE(SUM(c) OVER w, 0) AS clicks_pre,
  COALESCE(SUM(b) OVER w, 0) AS carts_pre, COALESCE(SUM(p) OVER w, 0) AS purchases_pre,
  LAG("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp") AS history_max_ts FROM t
  WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
ASOF_SQL = """cum AS (SELECT item_id, "timestamp" AS ts, SUM(COUNT(*)) OVER w AS n, SUM(SUM(rating)) OVER w AS s FROM ratings
  GROUP BY item_id, "timestamp" WINDOW w AS (PARTITION BY item_id ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING)),
rated AS (SELECT f.*, COALESCE(n, 0) AS item_review_count_pre, s / n AS item_rating_mean_pre FROM funnel f
  ASOF LEFT JOIN cum ON f.item_id = cum.item_id AND f."timestamp" > cum.ts)"""
SPLIT_SQL = """days AS (SELECT "timestamp" AS ts, COUNT(*) AS c FROM funnel GROUP BY 1),
run AS (SELECT ts, SUM(c) OVER (ORDER BY ts) AS e, SUM(c) OVER (ORDER BY ts) - c AS b FROM days),
n AS (SELECT SUM(c) AS n FROM days),
a AS (SELECT ts, e FROM run, n WHERE b < GREATEST(FLOOR(n * 0.2), 1) AND e >= GREATEST(FLOOR(n * 0.2), 1)),
bb AS (SELECT run.ts FROM run, n, a WHERE run.b < GREATEST(FLOOR(n * CAST(0.6000000000000001 AS DOUBLE)), a.e + 1)
  AND run.e >= GREATEST(FLOOR(n * CAST(0.6000000000000001 AS DOUBLE)), a.e + 1)),
parted AS (SELECT f.*, CASE WHEN "timestamp" <= a.ts THEN 'A' WHEN "timestamp" <= bb.ts THEN 'B' ELSE 'C' END AS split
  FROM funnel f, a, bb)"""


def split_funnel(spark, d):
    return SP.temporal_split(B.funnel(spark, d), "timestamp")


# ---- joins -------------------------------------------------------------------


@query(
    "J2_master_assembly",
    W(
        ["funnel", "users", "items", "measures"],
        sql_rounded(
            """SELECT category, tier, COUNT(*) AS n, SUM(y_purchase) AS purchases, SUM(T_con_mkt) AS mkt FROM funnel
            JOIN users USING (user_id) JOIN items USING (item_id) JOIN measures USING (item_id) WHERE price IS NOT NULL GROUP BY ALL""",
            ["category", "tier", "n"],
            ["purchases", "mkt"],
        ),
    ),
)
def master_assembly(spark, d):
    items = B.items(spark, d)
    prices = items.filter("price IS NOT NULL").select("item_id", "price")
    users = B.users(spark, d).select("user_id", "tier")
    joined = M.assemble(B.funnel(spark, d), users, prices, items.select("item_id", "category"), B.measures(spark, d).select("item_id", "T_con_mkt"))
    return joined.groupBy("category", "tier").agg(
        F.count("*").alias("n"), F.sum("y_purchase").cast("double").alias("purchases"), F.sum("T_con_mkt").alias("mkt")
    )


@query(
    "J3_asof_prior",
    W(
        ["funnel", "ratings"],
        sql_rounded(
            f"WITH {ASOF_SQL} SELECT * FROM rated", ["user_id", "item_id", "timestamp"], ["item_review_count_pre", "item_rating_mean_pre"]
        ),
    ),
)
def asof_prior(spark, d):
    joined = H.rating_history(B.funnel(spark, d), B.ratings(spark, d))
    return joined.select("user_id", "item_id", "timestamp", F.coalesce("item_review_count_pre", F.lit(0)).cast("double").alias("item_review_count_pre"), "item_rating_mean_pre")


@query(
    "J3_asof_prior_fine_clock",
    """WITH cum AS (SELECT user_id, epoch_us(ts) AS t, SUM(COUNT(*)) OVER w AS n FROM events WHERE event_type = 'click'
      GROUP BY user_id, epoch_us(ts) WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase')
    SELECT event_id, COALESCE(n, 0)::BIGINT AS clicks_pre FROM e ASOF LEFT JOIN cum ON e.user_id = cum.user_id AND e.t > cum.t""",
)
def asof_prior_fine_clock(spark, d):
    events = B.table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    probes = events.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    clicks = events.filter("event_type = 'click'").select("user_id", "t")
    joined = H.asof_prior(probes, clicks, "user_id", "t", {}, "clicks_pre", few_times=False)
    return joined.select("event_id", F.coalesce("clicks_pre", F.lit(0)).cast("bigint").alias("clicks_pre"))


@query(
    "W6_running_ratings",
    W(
        ["ratings"],
        sql_rounded(
            """SELECT item_id, "timestamp", SUM(COUNT(*)) OVER w AS n_pre, SUM(SUM(rating)) OVER w / SUM(COUNT(*)) OVER w AS mean_pre
            FROM ratings GROUP BY item_id, "timestamp" WINDOW w AS (PARTITION BY item_id ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
            ["item_id", "timestamp"],
            ["n_pre", "mean_pre"],
        ),
    ),
)
def running_ratings(spark, d):
    daily = B.ratings(spark, d).groupBy("item_id", "timestamp").agg(F.count("*").alias("_n"), F.sum("rating").alias("_s"))
    run = H.running_before(daily, ["item_id"], "timestamp", {"n_pre": "_n", "s_pre": "_s"})
    known = F.col("n_pre") > 0
    return run.select(
        "item_id", "timestamp", F.when(known, F.col("n_pre").cast("double")).alias("n_pre"), F.try_divide("s_pre", "n_pre").alias("mean_pre")
    )


@query(
    "J4_history_join_back",
    W(
        ["funnel"],
        f'WITH {PRIOR_SQL} SELECT f.user_id, f.item_id, f."timestamp", CAST(events_pre AS BIGINT) AS events_pre, CAST(purchases_pre AS BIGINT) AS purchases_pre FROM funnel f JOIN prior p ON f.user_id = p.user_id AND f."timestamp" = p."timestamp"',
    ),
)
def history_join_back(spark, d):
    out = H.prior_counts(B.funnel(spark, d), "user_id", "timestamp", {"purchases": "y_purchase"})
    return out.select("user_id", "item_id", "timestamp", "events_pre", "purchases_pre")


@query(
    "J7_occurrence_join",
    """WITH l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber) AS o FROM lineitem)
    SELECT l.l_orderkey, l.l_partkey AS left_part, r.l_partkey AS right_part, TRUE AS aligned FROM l JOIN r ON l.l_orderkey = r.l_orderkey AND l.o = r.o""",
)
def occurrence_join(spark, d):
    line = B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    left = line.withColumnRenamed("l_partkey", "left_part")
    right = line.withColumnRenamed("l_partkey", "right_part")
    joined = Q.occurrence_join(
        left, right, ["l_orderkey"], ["l_linenumber", "left_part", "l_suppkey", "l_extendedprice"],
        ["l_extendedprice", "right_part", "l_suppkey", "l_linenumber"],
    )
    check = Q.row_count_check(joined, line).select("aligned")
    return joined.select("l_orderkey", "left_part", "right_part").crossJoin(F.broadcast(check))


@query(
    "J8_channel_join",
    W(
        ["funnel", "ratings", "users"],
        f"""WITH {ASOF_SQL}, r AS MATERIALIZED (SELECT user_id, item_id, "timestamp", COALESCE(item_review_count_pre, 0)::BIGINT AS m, y_purchase - 0.33 AS res FROM rated WHERE "timestamp" >= 19950101),
        c AS MATERIALIZED (SELECT item_id, "timestamp" AS at, SUM(COUNT(*)) OVER (PARTITION BY item_id ORDER BY "timestamp") AS n FROM ratings GROUP BY item_id, "timestamp"),
        k AS MATERIALIZED (SELECT DISTINCT f.user_id, item_id, "timestamp", reg_year FROM funnel_raw f JOIN users u ON f.user_id = u.user_id WHERE reg_year IS NOT NULL),
        x AS MATERIALIZED (SELECT k.*, COALESCE(c.n, 0)::BIGINT AS m FROM k ASOF LEFT JOIN c ON k.item_id = c.item_id AND k."timestamp" > c.at)
        SELECT r.user_id, r.item_id, r."timestamp", r.m, ROUND(CAST(res AS DOUBLE), 6) AS res, x.reg_year FROM r JOIN x ON r.user_id = x.user_id AND r.item_id = x.item_id AND r."timestamp" = x."timestamp" AND r.m = x.m""",
    ),
)
def channel_join(spark, d):
    """Residual rows with the X table's columns on (user, item, time, M); users without an X row go.

    Each side counts M, the item's earlier ratings, on rows of its own.
    """
    keys = ["user_id", "item_id", "timestamp", "m"]
    counted = lambda df: H.rating_history(df, B.ratings(spark, d)).withColumn("m", F.coalesce("item_review_count_pre", F.lit(0)).cast("bigint"))
    residual = counted(B.funnel(spark, d)).filter(F.col("timestamp") >= 19950101).select(*keys, (F.col("y_purchase") - 0.33).cast("double").alias("res"))
    raw = B.funnel_raw(spark, d).select("user_id", "item_id", "timestamp").distinct()
    x = counted(raw.join(B.users(spark, d).filter("reg_year IS NOT NULL").select("user_id", "reg_year"), "user_id"))
    return residual.join(x.select(*keys, "reg_year"), keys)


@query(
    "J9_category_coverage",
    sql_rounded(
        """SELECT COUNT(*) AS required_items, COUNT(c) AS mapped_items, COUNT(*) - COUNT(c) AS missing_items,
        COUNT(*) FILTER (WHERE c = 'Unknown') AS unknown_category_items, COUNT(c) / COUNT(*) AS mapping_rate FROM (
        SELECT DISTINCT l_partkey, CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 9 = 1 THEN 'Unknown' ELSE p_type END AS c
        FROM lineitem JOIN part ON l_partkey = p_partkey)""",
        ["required_items", "mapped_items", "missing_items", "unknown_category_items"],
        ["mapping_rate"],
    ),
)
def category_coverage(spark, d):
    k = F.col("p_partkey") % 9
    table = B.table(spark, d, "part").filter(k != 0)
    categories = table.select(F.col("p_partkey").cast("string").alias("item_id"), F.when(k == 1, "Unknown").otherwise(F.col("p_type")).alias("category"))
    return RC.category_coverage(B.funnel(spark, d), categories)


@query(
    "W20_set_operations",
    """SELECT 'union' AS kind, COUNT(*) AS n FROM (SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer))
    UNION ALL SELECT 'difference', COUNT(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
    UNION ALL SELECT 'intersection', COUNT(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)""",
)
def set_operations(spark, d):
    a = B.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    b = B.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    parts = {"union": a.unionByName(b).distinct(), "difference": b.subtract(a), "intersection": b.intersect(a)}
    out = None
    for kind, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# ---- history windows -----------------------------------------------------------


@query(
    "W1_prior_counts",
    W(
        ["funnel"],
        sql_rounded(
            f'WITH {PRIOR_SQL} SELECT f.user_id, f.item_id, f."timestamp", ln(1 + events_pre) AS user_events_pre_log, ln(1 + clicks_pre) AS user_clicks_pre_log, ln(1 + carts_pre) AS user_carts_pre_log, ln(1 + purchases_pre) AS user_purchases_pre_log FROM funnel f JOIN prior p ON f.user_id = p.user_id AND f."timestamp" = p."timestamp"',
            ["user_id", "item_id", "timestamp"],
            ["user_events_pre_log", "user_clicks_pre_log", "user_carts_pre_log", "user_purchases_pre_log"],
        ),
    ),
)
def prior_counts(spark, d):
    flags = {"clicks": "y_click", "carts": "y_cart", "purchases": "y_purchase"}
    out = H.prior_counts(B.funnel(spark, d), "user_id", "timestamp", flags)
    return out.select("user_id", "item_id", "timestamp", *[f"user_{n}_pre_log" for n in ("events", *flags)])


@query(
    "W1_prior_counts_fine_clock",
    """SELECT event_id, (COUNT(*) OVER w)::BIGINT AS events_pre, COALESCE(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS clicks_pre
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def prior_counts_fine_clock(spark, d):
    events = B.table(spark, d, "events").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") == "click").cast("int").alias("c")
    )
    totals = events.groupBy("user_id", "t").agg(F.count("*").alias("_e"), F.sum("c").alias("_c"))
    before = H.running_before(totals, ["user_id"], "t", {"events_pre": "_e", "clicks_pre": "_c"}, few_times=False)
    return events.join(before, ["user_id", "t"]).select("event_id", F.col("events_pre").cast("bigint").alias("events_pre"), F.col("clicks_pre").cast("bigint").alias("clicks_pre"))


@query(
    "W2_history_max_ts",
    W(
        ["funnel"],
        f'WITH {PRIOR_SQL} SELECT f.user_id, f.item_id, f."timestamp", history_max_ts FROM funnel f JOIN prior p ON f.user_id = p.user_id AND f."timestamp" = p."timestamp"',
    ),
)
def history_max_ts(spark, d):
    return H.prior_counts(B.funnel(spark, d), "user_id", "timestamp", {}).select("user_id", "item_id", "timestamp", "history_max_ts")


AFFINITY_SQL = """fc AS (SELECT f.*, category FROM funnel f JOIN items USING (item_id)),
uc AS (SELECT user_id, category, "timestamp", SUM({flag}) AS n FROM fc GROUP BY ALL),
ub AS (SELECT user_id, "timestamp", COALESCE(SUM(SUM(n)) OVER (PARTITION BY user_id ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS den
  FROM uc GROUP BY user_id, "timestamp"),
cb AS (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY user_id, category ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num FROM uc),
aff AS (SELECT fc.user_id, fc.item_id, fc."timestamp", num, den, CASE WHEN den > 0 THEN num / den END AS share FROM fc
  JOIN cb ON fc.user_id = cb.user_id AND fc.category = cb.category AND fc."timestamp" = cb."timestamp"
  JOIN ub ON fc.user_id = ub.user_id AND fc."timestamp" = ub."timestamp")"""


def categorised(spark, d):
    return B.funnel(spark, d).join(B.items(spark, d).select("item_id", "category"), "item_id")


@query(
    "W3_category_affinity",
    W(
        ["funnel", "items"],
        sql_rounded(
            f"WITH {AFFINITY_SQL.format(flag='y_click')} SELECT *, COALESCE(share, 0.01) AS t_int_sem FROM aff",
            ["user_id", "item_id", "timestamp"],
            ["t_int_sem"],
        ),
    ),
)
def category_affinity(spark, d):
    out = H.category_affinity(categorised(spark, d), "user_id", "category", "timestamp", "y_click")
    return out.select("user_id", "item_id", "timestamp", F.col("T_int_sem").alias("t_int_sem"))


@query(
    "W3_category_affinity_missing",
    W(
        ["funnel", "items"],
        sql_rounded(
            f"WITH {AFFINITY_SQL.format(flag='y_purchase')} SELECT *, share AS t_int_sem, CASE WHEN den > 0 THEN 1 ELSE 0 END AS available FROM aff",
            ["user_id", "item_id", "timestamp", "available"],
            ["t_int_sem", "num", "den"],
        ),
    ),
)
def category_affinity_missing(spark, d):
    out = H.category_affinity(categorised(spark, d), "user_id", "category", "timestamp", "y_purchase", missing=None)
    return out.select(
        "user_id", "item_id", "timestamp", F.col("T_int_sem").alias("t_int_sem"), F.col("T_int_sem_available").alias("available"),
        F.col("T_int_sem_numerator").cast("double").alias("num"), F.col("T_int_sem_denominator").cast("double").alias("den"),
    )


@query(
    "W4_history_levels",
    W(
        ["funnel"],
        f"""WITH {PRIOR_SQL}, {SPLIT_SQL}, x AS (SELECT p.user_id, p.item_id, p."timestamp", p.split, ln(1 + events_pre) AS v FROM parted p JOIN prior q
          ON p.user_id = q.user_id AND p."timestamp" = q."timestamp"),
        cuts AS (SELECT quantile_cont(v, 1.0/3) AS c1, quantile_cont(v, 2.0/3) AS c2 FROM x WHERE split IN ('A', 'B') AND v > 0)
        SELECT user_id, item_id, "timestamp", split, CASE WHEN v <= 0 THEN 0 WHEN c1 = c2 THEN 1 + CAST(v > c1 AS INT)
          ELSE 1 + CAST(v >= c1 AS INT) + CAST(v >= c2 AS INT) END AS h_level FROM x, cuts""",
    ),
)
def history_levels(spark, d):
    out = H.prior_counts(B.funnel(spark, d), "user_id", "timestamp", {})
    out = SP.temporal_split(out, "timestamp")
    cuts = R.history_cuts(out.filter(F.col("split").isin("A", "B")), "user_events_pre_log")
    return out.select("user_id", "item_id", "timestamp", "split", R.history_level("user_events_pre_log", cuts).alias("h_level"))


@query(
    "W5_first_unique_texts",
    W(
        ["reviews"],
        """WITH u AS (SELECT item_id, review_text, MIN(ingest_order) AS ingest_order FROM reviews WHERE trim(review_text) <> '' GROUP BY ALL)
        SELECT item_id, ingest_order, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ingest_order) AS rank FROM u QUALIFY rank <= 5""",
    ),
)
def first_unique_texts(spark, d):
    from funnelweir.functions.text import first_unique_texts as first

    return first(B.reviews(spark, d)).select("item_id", "ingest_order", "rank")


# ---- ranks and bins --------------------------------------------------------------


def zprn_sql(source: str, value: str, key: str, seed) -> str:
    return f"""pos AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {value}, md5('{seed}|' || {key}), {key}) AS r, COUNT(*) OVER () AS n
      FROM {source} WHERE {value} > 0)"""


@query(
    "W7_zero_preserving_rank",
    W(
        ["measures"],
        f"""WITH {zprn_sql('measures', 'T_con_mkt', 'item_id', 7)}
        SELECT m.item_id, ROUND(COALESCE(r / n, 0), 6) + 0.0 AS score FROM measures m LEFT JOIN pos USING (item_id)""",
    ),
)
def zero_preserving_rank(spark, d):
    return R.zero_preserving_rank(B.measures(spark, d), "T_con_mkt", ["item_id"], "score", 7).select("item_id", "score")


@query(
    "W7_social_rank",
    W(
        ["funnel", "ratings"],
        f"""WITH {ASOF_SQL}, base AS (SELECT user_id, item_id, "timestamp", ln(1 + item_review_count_pre) AS v,
          user_id || '|' || item_id || '|' || "timestamp" AS k FROM rated),
        pos AS (SELECT *, ROW_NUMBER() OVER (ORDER BY v, md5('{M.SOCIAL_SEED}|' || k)) AS r, COUNT(*) OVER () AS n FROM base WHERE v > 0)
        SELECT b.user_id, b.item_id, b."timestamp", ROUND(COALESCE(r / n, 0), 6) + 0.0 AS t_con_soc FROM base b LEFT JOIN pos p USING (k)""",
    ),
)
def social_rank(spark, d):
    out = M.add_social(H.rating_history(B.funnel(spark, d), B.ratings(spark, d)))
    return out.select("user_id", "item_id", "timestamp", F.col("T_con_soc").alias("t_con_soc"))


def long_measures_sql() -> str:
    return "long AS (" + " UNION ALL ".join(
        f"SELECT item_id, '{c}' AS name, {c} AS value FROM measures" for c in B.RAW_CONSTRUCTS
    ) + ")"


@query(
    "W8_average_rank_share",
    W(
        ["measures"],
        f"""WITH {long_measures_sql()}, p AS (SELECT *, RANK() OVER w + (COUNT(*) OVER (PARTITION BY name, value) - 1) / 2.0 AS ar,
          COUNT(*) OVER (PARTITION BY name) AS n FROM long WHERE value > 0 WINDOW w AS (PARTITION BY name ORDER BY value))
        SELECT l.item_id, l.name, ROUND(COALESCE(ar / n, 0), 6) + 0.0 AS share FROM long l LEFT JOIN p USING (item_id, name)""",
    ),
)
def average_rank_share(spark, d):
    long = O.melt(B.measures(spark, d), B.RAW_CONSTRUCTS, ["item_id"])
    return R.average_rank_share(long, "value", "share", ["name"]).select("item_id", "name", "share")


@query(
    "W9_calibrate_measures",
    W(
        ["measures"],
        f"""WITH {long_measures_sql()}, p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY value, md5('{M.MEASURE_SEED}|' || item_id), item_id) AS r,
          COUNT(*) OVER (PARTITION BY name) AS n FROM long WHERE value > 0),
        z AS (SELECT l.item_id, l.name, COALESCE(r / n, 0) AS s FROM long l LEFT JOIN p USING (item_id, name))
        SELECT item_id, """
        + ", ".join(f"ROUND(MAX(CASE WHEN name = '{c}' THEN s END), 6) + 0.0 AS {c}_calib" for c in B.RAW_CONSTRUCTS)
        + " FROM z GROUP BY item_id",
    ),
)
def calibrate_measures(spark, d):
    return M.calibrate(B.measures(spark, d))


@query("W10_temporal_split", W(["funnel"], f'WITH {SPLIT_SQL} SELECT user_id, item_id, "timestamp", split FROM parted'))
def temporal_split(spark, d):
    return split_funnel(spark, d).select("user_id", "item_id", "timestamp", "split")


@query(
    "W11_train_validation",
    W(
        ["funnel"],
        """WITH days AS (SELECT "timestamp" AS ts, COUNT(*) AS c FROM funnel GROUP BY 1), run AS (SELECT ts, SUM(c) OVER (ORDER BY ts) AS e, SUM(c) OVER (ORDER BY ts) - c AS b FROM days),
        n AS (SELECT SUM(c) AS n FROM days), cutoff AS (SELECT ts FROM run, n WHERE b < FLOOR(n * 0.75) AND e >= FLOOR(n * 0.75))
        SELECT CASE WHEN "timestamp" <= ts THEN 'train' ELSE 'validation' END AS part, COUNT(*) AS n, MIN("timestamp") AS first_ts, MAX("timestamp") AS last_ts
        FROM funnel, cutoff GROUP BY 1""",
    ),
)
def train_validation(spark, d):
    parts = SP.train_validation(B.funnel(spark, d), "timestamp", 0.25)
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query(
    "W12_dense_ids",
    W(
        ["funnel"],
        """SELECT user_id, ROW_NUMBER() OVER (ORDER BY t, i, user_id) - 1 AS user_idx FROM (
        SELECT user_id, MIN("timestamp") AS t, MIN(item_id) FILTER (WHERE "timestamp" = m) AS i FROM (
          SELECT *, MIN("timestamp") OVER (PARTITION BY user_id) AS m FROM funnel) GROUP BY user_id)""",
    ),
)
def dense_ids(spark, d):
    return R.dense_ids(B.funnel(spark, d), "user_id", ["timestamp", "item_id"], "user_idx")


@query(
    "W14_top_one",
    W(["funnel", "measures"], """SELECT user_id, item_id, "timestamp" FROM funnel JOIN measures USING (item_id)
      QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY T_int_fac DESC, item_id, "timestamp") = 1"""),
)
def top_one(spark, d):
    scored = B.funnel(spark, d).join(B.measures(spark, d).select("item_id", "T_int_fac"), "item_id")
    return RC.top_one(scored, "T_int_fac", ["item_id", "timestamp"]).select("user_id", "item_id", "timestamp")


@query(
    "W15_tertiles",
    """WITH r AS (SELECT p_partkey, p_type, RANK() OVER w + (COUNT(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0 AS ar,
      COUNT(*) OVER (PARTITION BY p_type) AS n FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_size))
    SELECT p_partkey, CASE WHEN ar / n <= 1/3 THEN 'low' WHEN ar / n <= 2/3 THEN 'mid' ELSE 'high' END AS tertile FROM r""",
)
def tertiles(spark, d):
    return R.tertile_labels(B.table(spark, d, "part").select("p_partkey", "p_type", "p_size"), "p_size", "tertile", ["p_type"]).select("p_partkey", "tertile")


@query(
    "W16_quantile_bins",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM lineitem)
    SELECT bin, COUNT(*) AS n, MIN(l_extendedprice) AS low, MAX(l_extendedprice) AS high FROM (
      SELECT l_extendedprice, len(list_filter(e, lambda x: l_extendedprice > x)) AS bin FROM lineitem, q) GROUP BY bin""",
)
def quantile_bins(spark, d):
    line = B.table(spark, d, "lineitem").select("l_extendedprice")
    edges = O.quantile_edges(line, ["l_extendedprice"], 10)["l_extendedprice"]
    binned = line.withColumn("bin", O.right_closed_bin(F.col("l_extendedprice"), edges))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query(
    "W18_empirical_cdf",
    W(["measures"], f"""WITH {long_measures_sql()} SELECT DISTINCT name, value, ROUND(CUME_DIST() OVER (PARTITION BY name ORDER BY value), 6) + 0.0 AS cdf FROM long"""),
)
def empirical_cdf(spark, d):
    return R.empirical_cdf(B.measures(spark, d), B.RAW_CONSTRUCTS)


@query(
    "W19_stable_sort",
    W(["funnel"], """SELECT user_id, item_id, "timestamp", ROW_NUMBER() OVER (ORDER BY "timestamp", user_id, item_id) AS position FROM funnel"""),
)
def stable_sort(spark, d):
    rows = B.funnel(spark, d).select("user_id", "item_id", "timestamp")
    return O.global_row_number(rows, ["timestamp", "user_id", "item_id"], "position")


@query(
    "P21_social_iqr",
    W(
        ["funnel", "ratings"],
        sql_rounded(
            f"""WITH {ASOF_SQL}, x AS (SELECT *, ln(1 + item_review_count_pre) AS v FROM rated), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x)
            SELECT user_id, item_id, "timestamp", (v - a) / (b - a) AS t_con_soc_iqr FROM x, q""",
            ["user_id", "item_id", "timestamp"],
            ["t_con_soc_iqr"],
        ),
    ),
)
def social_iqr(spark, d):
    rated = H.rating_history(B.funnel(spark, d), B.ratings(spark, d))
    value = F.log1p(F.coalesce("item_review_count_pre", F.lit(0)).cast("double"))
    # three passes for the quartiles and one for the rows follow
    raw = stored(rated.select("user_id", "item_id", "timestamp", value.alias("v")))
    return M.social_iqr(raw, "v", "t_con_soc_iqr").select("user_id", "item_id", "timestamp", "t_con_soc_iqr")


@query(
    "P31_popularity_tiers",
    """WITH q AS (SELECT quantile_cont(p_size, 0.33) AS a, quantile_cont(p_size, 0.66) AS b FROM part)
    SELECT p_partkey, CASE WHEN p_size > b THEN 'PopularityProxy_Top' WHEN p_size > a THEN 'PopularityProxy_Mid' ELSE 'PopularityProxy_Tail' END AS position FROM part, q""",
)
def popularity_tiers(spark, d):
    names = ["PopularityProxy_Tail", "PopularityProxy_Mid", "PopularityProxy_Top"]
    return R.popularity_tiers(B.table(spark, d, "part").select("p_partkey", "p_size"), "p_size", names).select("p_partkey", "position")


# ---- aggregates and dimension tables -----------------------------------------------


@query(
    "A5_user_review_profile",
    sql_rounded(
        """WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, COUNT(*) AS c, AVG(o_totalprice) AS m FROM orders GROUP BY 1)
        SELECT user_id, c AS user_review_count, m AS user_avg_rating, (c - AVG(c) OVER ()) / STDDEV_POP(c) OVER () AS user_review_count_scaled,
        (m - AVG(m) OVER ()) / STDDEV_POP(m) OVER () AS user_avg_rating_scaled FROM a""",
        ["user_id"],
        ["user_review_count", "user_avg_rating", "user_review_count_scaled", "user_avg_rating_scaled"],
    ),
)
def user_review_profile(spark, d):
    reviews = B.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("user_id"), F.col("o_totalprice").alias("rating"))
    return D.user_review_profile(reviews)


@query(
    "A6_user_tenure",
    W(
        ["users"],
        sql_rounded(
            """WITH t AS (SELECT user_id, COALESCE(2025 - reg_year, MEDIAN(2025 - reg_year) OVER ()) AS user_tenure FROM users)
            SELECT user_id, user_tenure, (user_tenure - AVG(user_tenure) OVER ()) / STDDEV_POP(user_tenure) OVER () AS user_tenure_scaled FROM t""",
            ["user_id"],
            ["user_tenure", "user_tenure_scaled"],
        ),
    ),
)
def user_tenure(spark, d):
    return D.user_tenure(B.users(spark, d)).select("user_id", "user_tenure", "user_tenure_scaled")


#: The segments of the customer table and the name of a missing one.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Unknown")


@query(
    "A7_one_hot",
    "SELECT c_custkey, "
    + ", ".join(
        f"CASE WHEN COALESCE(CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END, 'Unknown') = '{v}' THEN 1 ELSE 0 END AS \"tier_{v}\""
        for v in SEGMENTS
    )
    + " FROM customer",
)
def one_hot(spark, d):
    tier = F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("tier")
    return D.one_hot(B.table(spark, d, "customer").select("c_custkey", tier), {"tier": SEGMENTS}).drop("tier")


@query(
    "A7_one_hot_long",
    """SELECT c_custkey, 'tier' AS "column", COALESCE(CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END, 'Unknown') AS value FROM customer""",
)
def one_hot_long(spark, d):
    tier = F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("tier")
    return D.one_hot_long(B.table(spark, d, "customer").select("c_custkey", tier), "c_custkey", ["tier"])


@query(
    "A8_median_impute",
    W(
        ["items"],
        sql_rounded(
            """SELECT item_id, ln(1 + COALESCE(price, MEDIAN(price) OVER (PARTITION BY category), MEDIAN(price) OVER ())) AS x_pri_log FROM items""",
            ["item_id"],
            ["x_pri_log"],
        ),
    ),
)
def median_impute(spark, d):
    return M.item_prices(B.items(spark, d))


@query(
    "A9_train_frequency",
    W(
        ["funnel"],
        sql_rounded(
            f"""WITH {SPLIT_SQL}, f AS (SELECT position, COUNT(*) / SUM(COUNT(*)) OVER () AS x FROM parted WHERE split IN ('A', 'B') GROUP BY position)
            SELECT split, p.position, COUNT(*) AS n, MAX(COALESCE(x, 0)) AS x_pos_freq FROM parted p LEFT JOIN f USING (position) GROUP BY ALL""",
            ["split", "position", "n"],
            ["x_pos_freq"],
        ),
    ),
)
def train_frequency(spark, d):
    out = D.train_frequency(split_funnel(spark, d), "position", F.col("split").isin("A", "B"), "x_pos_freq")
    return out.groupBy("split", "position").agg(F.count("*").alias("n"), F.max("x_pos_freq").alias("x_pos_freq"))


@query(
    "A10_split_summary",
    W(
        ["funnel"],
        sql_rounded(
            f"""WITH {SPLIT_SQL} SELECT COALESCE(split, 'All') AS split, COUNT(*) AS rows, MIN("timestamp") AS min_timestamp, MAX("timestamp") AS max_timestamp,
            AVG(y_purchase) AS purchase_rate FROM parted GROUP BY ROLLUP (split)""",
            ["split", "rows", "min_timestamp", "max_timestamp"],
            ["purchase_rate"],
        ),
    ),
)
def split_summary(spark, d):
    return SP.split_summary(split_funnel(spark, d), "split", "timestamp", {"purchase_rate": "y_purchase"})


@query(
    "A22_total_row",
    sql_rounded(
        """SELECT COALESCE(l_returnflag, 'All') AS l_returnflag, COUNT(*) AS rows, MIN(l_shipdate) AS min_timestamp, MAX(l_shipdate) AS max_timestamp,
        AVG(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag)""",
        ["l_returnflag", "rows", "min_timestamp", "max_timestamp"],
        ["quantity"],
    ),
)
def total_row(spark, d):
    return SP.split_summary(B.table(spark, d, "lineitem"), "l_returnflag", "l_shipdate", {"quantity": "l_quantity"})


@query(
    "A12_history_audit",
    W(
        ["funnel"],
        f"""WITH {PRIOR_SQL} SELECT COUNT(*) AS audited_rows, MAX(history_max_ts) AS max_source_timestamp, MIN(f."timestamp") AS min_event_timestamp,
        COUNT(*) FILTER (WHERE purchases_pre > 0 AND NOT COALESCE(history_max_ts < f."timestamp", FALSE)) AS violations,
        COUNT(*) FILTER (WHERE purchases_pre > 0 AND NOT COALESCE(history_max_ts < f."timestamp", FALSE)) = 0 AS pass
        FROM funnel f JOIN prior p ON f.user_id = p.user_id AND f."timestamp" = p."timestamp" """,
    ),
)
def history_audit(spark, d):
    out = H.prior_counts(B.funnel(spark, d), "user_id", "timestamp", {"purchases": "y_purchase"})
    return H.history_audit(out, "purchases_pre", "history_max_ts", "timestamp")


@query(
    "A13_dataset_statistics",
    W(
        ["users", "items", "funnel", "reviews", "ratings"],
        sql_rounded(
            r"""WITH l AS (SELECT unnest(string_split(review_text, chr(10))) AS line FROM reviews)
            SELECT (SELECT COUNT(DISTINCT user_id) FROM users) AS users, (SELECT COUNT(DISTINCT item_id) FROM items) AS items, COUNT(*) AS interactions,
            CAST(SUM(y_click) AS BIGINT) AS clicks, CAST(SUM(y_cart) AS BIGINT) AS carts, CAST(SUM(y_purchase) AS BIGINT) AS purchases,
            (SELECT COUNT(*) FROM l WHERE trim(line) <> '') AS reviews,
            (SELECT AVG(len(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' '))) FROM l WHERE trim(line) <> '') AS avg_review_length,
            (SELECT COUNT(*) FROM ratings) AS ratings, (SELECT AVG(rating) FROM ratings) AS avg_rating,
            COUNT(*) / ((SELECT COUNT(DISTINCT user_id) FROM users) * (SELECT COUNT(DISTINCT item_id) FROM items)) * 100 AS density_percent FROM funnel""",
            ["users", "items", "interactions", "clicks", "carts", "purchases", "reviews", "ratings"],
            ["avg_review_length", "avg_rating", "density_percent"],
        ),
    ),
)
def dataset_statistics(spark, d):
    return D.dataset_statistics(B.users(spark, d), B.items(spark, d), B.funnel(spark, d), B.reviews(spark, d), B.ratings(spark, d))


EDGES_SQL = "edges AS (SELECT DISTINCT user_id, item_id FROM funnel WHERE y_purchase = 1)"


def edges(spark, d):
    from funnelweir.operators.funnel import interaction_edges

    return interaction_edges(B.funnel(spark, d), "purchase")


@query("A19_interaction_edges", W(["funnel"], f"WITH {EDGES_SQL} SELECT * FROM edges"))
def interaction_edges(spark, d):
    return edges(spark, d)


@query(
    "A17_popularity",
    W(
        ["funnel"],
        sql_rounded(
            f"""WITH {EDGES_SQL}, p AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, COUNT(user_id) AS popularity, ln(1 + COUNT(user_id)) AS g FROM part LEFT JOIN edges
              ON CAST(p_partkey AS VARCHAR) = item_id GROUP BY 1) SELECT item_id, popularity, g AS popularity_log, (g - AVG(g) OVER ()) / STDDEV_POP(g) OVER () AS popularity_log_z FROM p""",
            ["item_id", "popularity"],
            ["popularity_log", "popularity_log_z"],
        ),
    ),
)
def popularity(spark, d):
    return D.popularity(edges(spark, d), B.items(spark, d))


@query(
    "A18_slot_popularity",
    W(
        ["funnel"],
        sql_rounded(
            """WITH e AS (SELECT item_id, ROW_NUMBER() OVER (ORDER BY "timestamp", user_id, item_id) AS r, COUNT(*) OVER () AS n FROM funnel WHERE y_purchase = 1),
            c AS (SELECT LEAST(4, (r - 1) * 5 // n) AS slot, item_id, COUNT(*) AS events FROM e GROUP BY ALL),
            f AS (SELECT t.slot::INT AS slot, CAST(p_partkey AS VARCHAR) AS item_id, COALESCE(events, 0) AS events FROM part CROSS JOIN range(5) t(slot)
              LEFT JOIN c ON c.slot = t.slot AND c.item_id = CAST(p_partkey AS VARCHAR)),
            s AS (SELECT slot, SUM(events) AS n, COUNT(*) AS items, MIN(events) AS lo, MAX(events) AS hi FROM f GROUP BY slot)
            SELECT f.slot, item_id, events, (events + 1) / (n + items) AS smoothed_share, (events - lo) / (n + items) / ((hi - lo) / (n + items) + 1e-10) AS scaled_popularity
            FROM f JOIN s USING (slot)""",
            ["slot", "item_id", "events"],
            ["smoothed_share", "scaled_popularity"],
        ),
    ),
)
def slot_popularity(spark, d):
    events = B.funnel(spark, d).filter("y_purchase = 1").select("user_id", "item_id", "timestamp")
    return D.slot_popularity(events, B.items(spark, d), ["timestamp", "user_id", "item_id"])


def indexed_edges(spark, d):
    pairs = edges(spark, d)
    return pairs.select(F.col("user_id").cast("bigint").alias("u"), F.col("item_id").cast("bigint").alias("i"))


GRAPH_SQL = f"""{EDGES_SQL}, nu AS (SELECT COUNT(*) AS k FROM customer), fwd AS (SELECT CAST(user_id AS BIGINT) AS src, CAST(item_id AS BIGINT) + k AS dst FROM edges, nu),
graph AS (SELECT * FROM fwd UNION ALL SELECT dst, src FROM fwd), deg AS (SELECT src, COUNT(*) AS d FROM graph GROUP BY src)"""


@query(
    "A20_symmetric_adjacency",
    W(["funnel"], sql_rounded(f"WITH {GRAPH_SQL} SELECT g.src, g.dst, 1 / sqrt(a.d * b.d) AS weight FROM graph g JOIN deg a ON g.src = a.src JOIN deg b ON g.dst = b.src", ["src", "dst"], ["weight"])),
)
def symmetric_adjacency(spark, d):
    graph = D.bipartite_edges(indexed_edges(spark, d), B.table(spark, d, "customer").count())
    return D.normalized_adjacency(graph)


@query(
    "A20_row_adjacency",
    W(["funnel"], sql_rounded(f"WITH {GRAPH_SQL} SELECT g.src, g.dst, 1 / a.d AS weight FROM graph g JOIN deg a ON g.src = a.src", ["src", "dst"], ["weight"])),
)
def row_adjacency(spark, d):
    graph = D.bipartite_edges(indexed_edges(spark, d), B.table(spark, d, "customer").count())
    return D.normalized_adjacency(graph, symmetric=False)


@query(
    "S10_interaction_lines",
    W(["funnel"], f"""WITH {EDGES_SQL} SELECT user_id || ' ' || string_agg(item_id, ' ' ORDER BY item_id) AS value FROM edges GROUP BY user_id"""),
)
def interaction_lines(spark, d):
    return D.interaction_lines(edges(spark, d), "user_id", "item_id")


@query("S10_pair_lines", W(["funnel"], f"WITH {EDGES_SQL} SELECT user_id || ' ' || item_id AS value FROM edges"))
def pair_lines(spark, d):
    return D.pair_lines(edges(spark, d), ["user_id", "item_id"])


@query(
    "exact_quantiles",
    sql_rounded(
        """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.25) AS p25,
        quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY l_returnflag""",
        ["l_returnflag"],
        ["p01", "p25", "p50", "p99"],
    ),
)
def exact_quantiles(spark, d):
    q = O.exact_quantiles(B.table(spark, d, "lineitem"), ["l_extendedprice"], [0.01, 0.25, 0.5, 0.99], ["l_returnflag"])
    return q.select("l_returnflag", F.col("p0").alias("p01"), F.col("p1").alias("p25"), F.col("p2").alias("p50"), F.col("p3").alias("p99"))

