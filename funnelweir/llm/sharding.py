"""Shards of near-equal bytes by sampled splitters.

1. Every record gets a size (UTF-8 bytes of the text plus ``overhead``) and a key: the hash
   of its text, then its id. Equal texts are neighbours in key order.
2. A sample of keys is drawn with a chance in proportion to the size, by a hash of the id, so
   a retried task draws the same. Its expected number is ``shards * per_shard``, whatever
   the size of the input.
3. Quantiles of the sample are the boundaries of ``shards * ranges_per_shard`` ranges of
   about equal bytes; a binary search over them places each record.
4. Ranges that hold over twice their share of bytes (one text with many copies, or an
   unlucky sample) are subdivided by a hash of the id.
5. Totals of the ranges, summed in order, give where each starts; a running sum inside a
   range gives each record's place in the whole, and the place gives shard and slot.

Everything is a DataFrame operation. The broadcast table has a row per range and part: at
most ``ranges + bytes / share``, that is twice the number of ranges.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelweir.llm.common import cut

#: Keys are compared as whole numbers that a double holds exactly.
KEY_BITS = 52


def measured(docs: DataFrame, overhead: int, id_column: str, text_column: str) -> DataFrame:
    """id, size, crc, key, pick (uniform in [0, 1) by the id): one narrow row per document."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit("pick"), "id"), 64 - KEY_BITS).cast("double") / float(1 << KEY_BITS)
    rows = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).cast("double").alias("key"),
    )
    return rows.withColumn("pick", uniform)


def splitters(rows: DataFrame, total: int, ranges: int, wanted: int) -> list[float]:
    """At most ``ranges - 1`` rising keys: quantiles of a size-weighted sample of about ``wanted`` keys."""
    sample = rows.filter(F.col("pick") * total < F.col("size") * wanted).select("key")
    ordered = sample.select("key", F.ntile(ranges).over(Window.orderBy("key")).alias("tile"))
    firsts = ordered.groupBy("tile").agg(F.min("key").alias("key")).filter("tile > 1").select("key").distinct()
    return sorted(r["key"] for r in firsts.collect())


def byte_shards(
    docs: DataFrame, shards: int = 40, ranges_per_shard: int = 8, per_shard: int = 100, overhead: int = 16, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id, size, text_crc32, shard, slot: every row in exactly one shard, slots gapless from 0.

    A record belongs to the shard that the middle of its bytes falls in, so sizes differ
    from each other by at most the largest record. Null texts count as empty. Rows that
    repeat an id and a text are placed one by one; a null id hashes like a value.
    """
    rows = cut(measured(docs, overhead, id_column, text_column))
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    cuts = splitters(rows, total, ranges, shards * per_shard)
    edges = [float("-inf"), *cuts, float("inf")]
    if cuts:
        ranged = Bucketizer(splits=edges, inputCol="key", outputCol="range").transform(rows).withColumn("range", F.col("range").cast("int"))
    else:
        ranged = rows.withColumn("range", F.lit(0))
    share = max(1, total // ranges)
    filled = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    parts = filled.select("range", F.when(F.col("bytes") > 2 * share, F.ceil(F.col("bytes") / share)).otherwise(F.lit(1)).cast("int").alias("parts"))
    split = ranged.join(F.broadcast(parts), "range").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.col("parts")).cast("int"))
    sums = split.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "range",
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("records").over(before), F.lit(0)).alias("records_before"),
    )
    inside = Window.partitionBy("range", "part").orderBy("key", "id", "crc")
    running = split.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row", F.row_number().over(inside))
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / max(1, total))).cast("int")
    placed = cut(running.join(F.broadcast(starts), ["range", "part"]).select("id", "size", "crc", shard.alias("shard"), (F.col("records_before") + F.col("row") - 1).alias("place")))
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).alias("slot")
    )
