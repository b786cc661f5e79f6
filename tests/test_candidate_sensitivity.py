import random

from pyspark.sql import functions as F

from funnelweir.operators import ranking as RK
from funnelweir.operators import sampling as SA
from funnelweir.operators import splits as SP
from funnelweir.plans import evaluation as EV
from funnelweir.plans import features as FE


def order_tables(spark, folder):
    """Order lines of 12 users over 30 days as Parquet, for the plans that read the funnel and ratings."""
    days = [f"1995-{m:02d}-{k:02d}" for m in (1, 2, 3) for k in range(1, 11)]
    orders = [(o, o % 12, days[o % 30]) for o in range(120)]
    lines = [(o, (o * 7 + n * 3) % 25, o % 10, "O" if (o + n) % 2 else "F", "ANR"[(o + n) % 3], float(1 + (o + n) % 50), days[(o * 3 + n) % 30]) for o in range(120) for n in range(4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "cast(d as timestamp_ntz) o_orderdate").write.parquet(f"{folder}/orders.parquet")
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linestatus string, l_returnflag string, l_quantity double, d string"
    spark.createDataFrame(lines, schema).selectExpr("*", "cast(d as timestamp_ntz) l_shipdate").drop("d").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_runs_share_one_shuffle_of_the_scores(spark):
    """The runs are those of the nested subsamples, with repeated and missing keys, an item on both sides and unknown labels."""
    rng = random.Random(3)
    rows = []
    for u in range(6):
        for i in range(12):
            rows += [(m, "s", f"u{u}", f"i{i}", i == u, rng.randrange(5) / 5.0) for m in ("ours", "alpha")]
    rows += [("ours", "s", "u1", "i3", False, 0.2), ("ours", "s", "u1", "i1", False, 0.4), ("ours", "s", "u2", None, False, 0.9), ("ours", "s", None, "i2", True, 0.9), ("alpha", "s", "u3", "i20", None, 0.7)]
    scores = spark.createDataFrame(rows, "model string, stage string, user_id string, item_id string, is_target boolean, score double")
    got = RK.candidate_sensitivity(scores, [4, 99], [1, 2], 7)
    lists = scores.select("stage", "user_id", "item_id", "is_target").distinct()
    parts = []
    for count, replicate in ((4, 1), (4, 2), (99, 1)):
        kept = lists if count == 99 else SA.nested_subsample(lists, ["stage", "user_id"], "item_id", count, 7, replicate)
        part = scores.join(kept.drop("is_target"), ["stage", "user_id", "item_id"], "left_semi")
        users = RK.expected_metrics(part)
        parts.append(RK.metric_summary(users).withColumns({"negative_count": F.lit(count), "replicate": F.lit(replicate)}))
    want = parts[0].unionByName(parts[1]).unionByName(parts[2]).select(got.columns)
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert [p for p in zip(shown(got), shown(want)) if p[0] != p[1]] == []
    # scores by list, then one row per list and run, and one row per model and run
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") <= 2


def test_dealt_scores_are_not_shuffled_again(spark):
    rows = [(m, "s", f"u{u}", f"i{i}", i == u, (7 * i + 3 * u) % 5 / 5.0) for m in ("ours", "alpha") for u in range(5) for i in range(9)]
    scores = spark.createDataFrame(rows, "model string, stage string, user_id string, item_id string, is_target boolean, score double")
    got = RK.candidate_sensitivity(scores.repartition("stage", "user_id"), [4, 99], [1, 2], 7, dealt=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the caller's own, and one row per model and run
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert shown(got) == shown(RK.candidate_sensitivity(scores, [4, 99], [1, 2], 7))


def test_candidates_look_for_boundaries_in_stored_rows(spark, monkeypatch, tmp_path):
    read, found = [], SP.abc_boundaries
    monkeypatch.setattr(SP, "abc_boundaries", lambda df, *rest: read.extend(df.inputFiles()) or found(df, *rest))
    b, c = EV.set_b_c(spark, order_tables(spark, tmp_path))
    assert read and not any("lineitem" in f for f in read)
    assert b.count() > 0 and not any("lineitem" in f for f in c.inputFiles())


def test_social_iqr_reads_its_rows_once(spark, tmp_path):
    out = FE.social_iqr(spark, order_tables(spark, tmp_path))
    assert not any("lineitem" in f for f in out.inputFiles()) and out.count() > 0
