import pytest
from pyspark.sql import functions as F

from funnelweir.functions import scalars as S
from funnelweir.functions import text as T
from funnelweir.operators import quality as Q
from funnelweir.sources import tables as IO


def test_delimited_twin_in_another_encoding(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("品牌,n\n苏宁,1\n默认,2\n".encode("gb18030"))
    df = IO.read_table(spark, str(tmp_path / "t.parquet"))
    assert [r[0] for r in df.orderBy("n").collect()] == ["苏宁", "默认"]
    with pytest.raises(FileNotFoundError):
        IO.read_table(spark, str(tmp_path / "missing.parquet"))


def test_byte_order_mark_is_dropped(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿a,b\n1,2\n".encode("utf-8"))
    assert IO.read_table(spark, str(tmp_path / "u.csv")).columns == ["a", "b"]


def test_write_and_manifest_round_trip(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    IO.write_table(df, str(tmp_path / "t"))
    assert IO.read_table(spark, str(tmp_path / "t.parquet"), ["x"]).columns == ["x"]
    IO.write_manifest(df, str(tmp_path / "m"), {"artefact": "t"})
    IO.check_manifest(df.repartition(7), str(tmp_path / "m"))
    with pytest.raises(ValueError):
        IO.check_manifest(df.filter("id > 0"), str(tmp_path / "m"))


def test_category_labels_in_two_languages(spark):
    rows = [("1", "Brand: A | Category: Toys | Product name: x"), ("2", "品牌：甲 | 类目：玩具 | 名称：x"), ("3", None)]
    items = spark.createDataFrame(rows, "item_id string, text_W string")
    assert {r.item_id: r.category for r in T.category_table(items).collect()} == {"1": "Toys", "2": "玩具", "3": "Unknown"}
    plain = spark.createDataFrame([("1", "a | b | c")], "item_id string, text_W string")
    assert T.category_table(plain).first().category == "b"


def test_item_ids(spark):
    df = spark.createDataFrame([("  0012.0",), ("000",), ("7",)], "item_id string")
    assert [r[0] for r in S.normalize_ids(df, ["item_id"]).collect()] == ["12", "", "7"]
    assert [r[0] for r in df.select(S.clean_item_id_keep_zero("item_id")).collect()] == ["12", "0", "7"]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (2.0,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(S.clip(F.col("x"))).collect()] == [None, 1.0, 0.0]


def test_forbidden_columns_raise(spark):
    with pytest.raises(ValueError):
        S.require_columns(spark.range(1), ["id", "user_avg_rating"], ["user_avg_rating"])


def test_checks_raise_on_failure(spark):
    checks = Q.expect(spark.range(5), {"small": F.col("id") < 3, "known": F.col("id").isNotNull()})
    assert {r.check_name: r.violations for r in checks.collect()} == {"small": 2, "known": 0}
    with pytest.raises(ValueError):
        Q.require_pass(checks)


def test_replies_with_nested_and_broken_json(spark):
    rows = [("a", 'x {"scores": {"T_con_mkt": "11", "T_int_vis": 3}} y'), ("b", "{broken"), ("c", '{"schema_valid": false, "T_con_mkt": 1, "T_int_vis": 2}')]
    got = {r.item: r for r in T.parse_score_replies(spark.createDataFrame(rows, "item string, response string"), "response", ["T_con_mkt", "T_int_vis"]).collect()}
    assert got["a"].schema_valid and got["a"].T_con_mkt_0_10 == 10.0 and got["a"].notes == "clipped_T_con_mkt"
    assert not got["b"].schema_valid and got["b"].notes == "json_parse_error"
    assert not got["c"].schema_valid and got["c"].T_int_vis_0_10 == 2.0


def test_spread_deals_the_rows_of_one_scan_task(spark):
    from funnelweir.sources.tables import spread

    out = spread(spark.range(0, 1000, 1, 1), "id")
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert out.count() == 1000 and len(sizes) > 1 and max(r["count"] for r in sizes) < 1000
