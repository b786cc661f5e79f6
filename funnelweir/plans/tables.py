"""Funnel tables derived from the order, part, document and event tables.

Each has a Spark builder and a SQL twin of the same name for the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelweir.functions import scalars as S
from funnelweir.functions import text as T
from funnelweir.operators import funnel as FN
from funnelweir.sources.tables import read_table

RAW_CONSTRUCTS = [
    "T_con_mkt",
    "T_int_vis",
    "T_int_fac",
    "atomic_a_pri",
    "atomic_a_gft",
    "atomic_a_sub",
    "atomic_a_urg",
    "atomic_a_spec",
    "atomic_a_str",
]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, f"{d}/{name}.parquet")


def funnel_raw(spark: SparkSession, d: str, users: DataFrame | None = None) -> DataFrame:
    """Order lines as events; with ``users`` only those of known users, dropped order by order."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if users is not None:
        orders = orders.join(users.select("user_id"), F.col("o_custkey").cast("string") == F.col("user_id"), "left_semi")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("item_id"),
        S.date_number(F.col("o_orderdate")).cast("bigint").alias("timestamp"),
        (F.col("l_linestatus") == "O").cast("int").alias("y_click"),
        (F.col("l_returnflag") == "A").cast("int").alias("y_cart"),
        (F.col("l_returnflag") == "N").cast("int").alias("y_purchase"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string")).alias("position"),
    )


def funnel(spark: SparkSession, d: str, users: DataFrame | None = None) -> DataFrame:
    return FN.collapse_duplicates(FN.close_funnel(funnel_raw(spark, d, users)))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("item_id"),
        S.date_number(F.col("l_shipdate")).cast("bigint").alias("timestamp"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"),
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 17 != 0, F.col("p_retailprice")).alias("price"),
        T.item_text("p_brand", ["p_type", "p_type", "p_type"], "p_name").alias("text_W"),
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("c_mktsegment").alias("tier"),
        F.col("n_name").alias("city_tie"),
        F.when(F.col("c_custkey") % 11 != 0, 2005 + F.col("c_nationkey") % 20).cast("int").alias("reg_year"),
    )


def measures(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey")
    scores = [
        (((F.col("p_partkey") * 7919 + c * 104729) % 11) / 10.0).alias(name) for c, name in enumerate(RAW_CONSTRUCTS)
    ]
    return part.select(F.col("p_partkey").cast("string").alias("item_id"), *scores)


def reviews(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sizes = [table(spark, d, t).agg(F.count("*").alias(n)) for t, n in (("customer", "_u"), ("part", "_i"))]
    wide = docs.crossJoin(F.broadcast(sizes[0])).crossJoin(F.broadcast(sizes[1]))
    doc = F.col("doc_id")
    return wide.select(
        (doc % F.col("_u")).cast("string").alias("user_id"),
        ((doc * 7) % (F.col("_i") / 4).cast("bigint")).cast("string").alias("item_id"),
        F.col("text").alias("review_text"),
        "lang",
        (F.lit(19950101) + (doc % 7) * 10000 + (doc % 12) * 100 + doc % 28).cast("bigint").alias("timestamp"),
        doc.alias("ingest_order"),
    )


SQL: dict[str, str] = {
    "funnel_raw": """
SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id,
       CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS "timestamp",
       CAST(l_linestatus = 'O' AS INT) AS y_click, CAST(l_returnflag = 'A' AS INT) AS y_cart,
       CAST(l_returnflag = 'N' AS INT) AS y_purchase, 'S' || CAST(l_suppkey % 5 AS VARCHAR) AS position
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "funnel": """
SELECT user_id, item_id, "timestamp", MAX(GREATEST(y_click, y_cart, y_purchase)) AS y_click,
       MAX(GREATEST(y_cart, y_purchase)) AS y_cart, MAX(y_purchase) AS y_purchase,
       COALESCE(MIN(position) FILTER (WHERE position <> 'trans_direct'), 'trans_direct') AS position
FROM funnel_raw GROUP BY user_id, item_id, "timestamp" """,
    "ratings": """
SELECT CAST(l_partkey AS VARCHAR) AS item_id, CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT) AS "timestamp",
       CAST(1 + FLOOR((l_quantity - 1) / 10) AS DOUBLE) AS rating FROM lineitem""",
    "items": """
SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_brand AS brand, p_type AS category, p_name AS name,
       CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice END AS price,
       'Brand: ' || p_brand || ' | Category: ' || p_type || '-' || p_type || '-' || p_type
         || ' | Product name: ' || p_name AS text_W FROM part""",
    "users": """
SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_mktsegment AS tier, n_name AS city_tie,
       CASE WHEN c_custkey % 11 <> 0 THEN 2005 + c_nationkey % 20 END AS reg_year
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "measures": "SELECT CAST(p_partkey AS VARCHAR) AS item_id, "
    + ", ".join(f"((p_partkey * 7919 + {c * 104729}) % 11) / 10.0 AS {n}" for c, n in enumerate(RAW_CONSTRUCTS))
    + " FROM part",
    "reviews": """
SELECT CAST(doc_id % (SELECT COUNT(*) FROM customer) AS VARCHAR) AS user_id,
       CAST((doc_id * 7) % CAST(FLOOR((SELECT COUNT(*) FROM part) / 4) AS BIGINT) AS VARCHAR) AS item_id,
       text AS review_text, lang,
       CAST(19950101 + (doc_id % 7) * 10000 + (doc_id % 12) * 100 + doc_id % 28 AS BIGINT) AS "timestamp",
       doc_id AS ingest_order FROM documents""",
}
NEEDS = {"funnel": ["funnel_raw"]}


def sql_with(names: list[str], body: str) -> str:
    """``body`` preceded by the named table definitions."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
