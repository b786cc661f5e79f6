"""A fast share of the registered queries against their SQL twins; tools/check_oracle.py runs all."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from tools.check_oracle import TABLES, table

NAMES = [
    "S2_write_table", "S3_reviews_jsonl", "S4_item_metadata", "S11_manifest_digest", "P4_day_key", "P9_parse_price", "P12_category",
    "P28_weighted_replies", "P29_score_replies", "J1_merge_logs", "J3_asof_prior", "J7_occurrence_join", "A4_merge_sources",
    "A8_median_impute", "A18_slot_popularity", "W1_prior_counts", "W3_category_affinity_missing", "W4_history_levels",
    "W7_social_rank", "W9_calibrate_measures", "W10_temporal_split", "W16_quantile_bins", "E2_support_gate", "E3_two_way_clustered_ols",
    "E8_holm", "E12_wald_test", "M1_treatment_residuals", "M7_pathway_projection", "D1_item_certification", "D3_restrict_splits",
    "D6_nuisance_transport", "R10_cluster_bootstrap", "R13_permutation", "R6_stratified_sample", "REC4_multi_positive", "G6_agreement_bundle", "G7_icc",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"treatment", "coefficient", "p_holm"} <= set(rows[0].asDict())
    assert any(r["estimable"] and r["std_error"] > 0 for r in rows)
