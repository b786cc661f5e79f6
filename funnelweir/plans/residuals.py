"""Residual tables with closed-form columns, for effect queries both engines can state.

Treatments and outcomes are centred functions of line, order and part columns;
the semantic treatment is missing at history level 0 and on some other lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelweir.functions import scalars as S
from funnelweir.plans import tables as B

HEURISTIC = ["res_T_con_mkt", "res_T_con_soc"]
ANALYTICAL = ["res_T_int_fac", "res_T_int_sem"]
OUTCOMES = ["res_y_click", "res_y_cart", "res_y_purchase"]
CUES = [*HEURISTIC, *ANALYTICAL]

SQL = """resid AS MATERIALIZED (SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id,
  CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS "timestamp", o_orderkey, l_linenumber, (o_custkey % 4)::INT AS H_level,
  CASE WHEN year(o_orderdate) <= 1997 THEN 'B' ELSE 'C' END AS split,
  l_discount - 0.05 AS res_T_con_mkt, l_tax - 0.04 AS res_T_con_soc, l_quantity / 50 - 0.5 + 0.8 * (l_discount - 0.05) AS res_T_int_fac,
  CASE WHEN o_custkey % 4 > 0 AND l_linenumber < 7 THEN (l_suppkey % 21) / 20.0 - 0.5 + 1.5 * (l_tax - 0.04) END AS res_T_int_sem,
  CAST(l_linestatus = 'O' AS INT) - 0.5 + 0.3 * (l_discount - 0.05) AS res_y_click,
  CAST(l_returnflag = 'A' AS INT) - 0.33 + 0.2 * (l_quantity / 50 - 0.5) AS res_y_cart,
  CAST(l_returnflag = 'N' AS INT) - 0.33 - 0.1 * (l_quantity / 50 - 0.5) + 0.4 * (l_tax - 0.04) AS res_y_purchase
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def residuals(spark: SparkSession, d: str) -> DataFrame:
    line = B.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    orders = B.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    mkt, soc, amount = F.col("l_discount") - 0.05, F.col("l_tax") - 0.04, F.col("l_quantity") / 50 - 0.5
    level = (F.col("o_custkey") % 4).cast("int")
    return j.select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("item_id"),
        S.date_number(F.col("o_orderdate")).cast("bigint").alias("timestamp"),
        "o_orderkey",
        "l_linenumber",
        level.alias("H_level"),
        F.when(F.year("o_orderdate") <= 1997, "B").otherwise("C").alias("split"),
        mkt.alias("res_T_con_mkt"),
        soc.alias("res_T_con_soc"),
        (amount + 0.8 * mkt).alias("res_T_int_fac"),
        F.when((level > 0) & (F.col("l_linenumber") < 7), (F.col("l_suppkey") % 21) / 20.0 - 0.5 + 1.5 * soc).alias("res_T_int_sem"),
        ((F.col("l_linestatus") == "O").cast("int") - 0.5 + 0.3 * mkt).alias("res_y_click"),
        ((F.col("l_returnflag") == "A").cast("int") - 0.33 + 0.2 * amount).alias("res_y_cart"),
        ((F.col("l_returnflag") == "N").cast("int") - 0.33 - 0.1 * amount + 0.4 * soc).alias("res_y_purchase"),
    )
