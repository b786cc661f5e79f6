"""Line-JSON sources for reviews and item metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("verified_purchase", T.BooleanType()),
        T.StructField("images", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
IMAGE_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("variant", "hi_res", "large")])
META_SCHEMA = T.StructType(
    [
        T.StructField("parent_asin", T.StringType()),
        T.StructField("rating_number", T.DoubleType()),
        T.StructField("average_rating", T.DoubleType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("main_category", T.StringType()),
        T.StructField("store", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("price", T.StringType()),
        T.StructField("images", T.ArrayType(IMAGE_TYPE)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def parse_lines(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Text lines parsed with a fixed schema, other columns kept; blank and broken lines are dropped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    kept = [c for c in lines.columns if c != value]
    parsed = lines.filter(F.trim(F.col(value)) != "").select(*kept, F.from_json(value, schema, options).alias("_j"))
    return parsed.filter("_j._corrupt_record IS NULL").select(*kept, "_j.*").drop("_corrupt_record")


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return parse_lines(spark.read.text(path), schema)


def purchase_records(reviews: DataFrame) -> DataFrame:
    """One purchase-positive row per (user, item, timestamp) of usable review lines."""
    item = F.col("parent_asin")
    usable = reviews.filter(
        (F.col("user_id") != "") & (item != "") & F.col("timestamp").isNotNull()
    ).select("user_id", item.alias("item_id"), "timestamp", "rating", "verified_purchase")
    unique = usable.groupBy("user_id", "item_id", "timestamp").agg(
        F.min_by(F.struct("rating", "verified_purchase"), F.struct("rating", "verified_purchase")).alias("_r")
    )
    return unique.select(
        "user_id",
        "item_id",
        "timestamp",
        F.lit(1).alias("y_purchase"),
        F.when(F.col("_r.rating") != 0, F.col("_r.rating")).alias("rating"),
        F.col("_r.verified_purchase").alias("verified_purchase"),
        F.lit("observed_review_rating_record").alias("outcome_source"),
        F.lit(0).alias("is_sampled_nonpurchase"),
    )


def item_pool(meta: DataFrame, order: str) -> DataFrame:
    """item_id, popularity, category; the last line per item (by ``order``) wins."""
    path = F.when(F.size("categories") > 0, F.array_join("categories", "|"))
    filled = F.when(F.col("main_category") != "", F.col("main_category"))
    named = meta.filter(F.col("parent_asin") != "").select(
        F.col("parent_asin").alias("item_id"),
        F.coalesce("rating_number", F.lit(0.0)).alias("popularity"),
        F.coalesce(path, filled, F.lit("Unknown")).alias("category"),
        order,
    )
    last = named.groupBy("item_id").agg(F.max_by(F.struct("popularity", "category"), order).alias("_r"))
    return last.select("item_id", "_r.popularity", "_r.category")


def image_tasks(meta: DataFrame, order: str) -> DataFrame:
    """The first available best-image URL per item; NULL when no line has one."""
    from funnelweir.functions.scalars import best_image

    urls = meta.filter(F.col("parent_asin") != "").select(
        F.col("parent_asin").alias("asin"), best_image("images").alias("url"), order
    )
    first = F.min_by("url", F.when(F.col("url").isNotNull(), F.col(order)))
    return urls.groupBy("asin").agg(first.alias("url"))
