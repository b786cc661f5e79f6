"""Edge cases of splits, negatives and line files."""

import pytest
from pyspark.sql import functions as F

from funnelweir.operators import describe as D
from funnelweir.operators import sampling as SA
from funnelweir.operators import splits as SP


def test_second_part_is_never_empty(spark):
    df = spark.createDataFrame([(t,) for t in [1, 1, 1, 2, 2, 2, 2, 2, 2, 2]], "ts long")
    parts = {r["part"]: r["count"] for r in SP.train_validation(df, "ts", 0.25).groupBy("part").count().collect()}
    assert parts == {"train": 3, "validation": 7}


def test_one_timestamp_cannot_be_split(spark):
    with pytest.raises(ValueError, match="one value"):
        SP.train_validation(spark.createDataFrame([(5,), (5,)], "ts long"), "ts", 0.25)


@pytest.mark.parametrize("attempts", [1, 100])
def test_every_edge_of_a_user_with_one_unseen_item_gets_it(spark, attempts):
    items = spark.range(300).select(F.col("id").alias("item_id"))
    edges = spark.range(299).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("item_id"))
    edges = edges.union(spark.createDataFrame([(2, 5)], "user_id long, item_id long"))
    rows = SA.training_triples(edges, "user_id", "item_id", items, 2, 3, attempts).collect()
    assert len(rows) == 600 and {r["negative"] for r in rows if r["user_id"] == 1} == {299}
    assert all(r["negative"] != 5 for r in rows if r["user_id"] == 2)


def test_one_line_per_user(spark):
    edges = spark.range(1000).select(F.lit(7).alias("u"), F.col("id").alias("i"))
    assert [r["value"] for r in D.interaction_lines(edges, "u", "i").collect()] == [" ".join(map(str, [7, *range(1000)]))]
