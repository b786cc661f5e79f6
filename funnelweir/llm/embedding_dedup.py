"""Near duplicates among vectors by collision counting on one-dimensional projections.

1. Vectors that are null, empty, zero or not finite link with nothing. Equal vectors become
   one class with a weight, so copies never form pairs.
2. Each class is projected onto ``tables`` seeded Gaussian directions. A query-centred
   window of half-width ``reach`` around a projection holds a vector at the threshold's
   distance with a known probability, and closer ones with a higher one. Windows alone keep
   a fixed share of all pairs whatever their width, so every projection is sorted inside
   the cell given by the signs of ``bits`` further projections; the number of bits follows
   the number of vectors, so a cell holds few unrelated ones.
3. Pairs are counted over the tables. ``needed`` collisions is the largest count that a pair
   exactly at the threshold still reaches with probability ``recall`` (binomial tail); more
   tables are taken until two collisions are asked for.
4. Pairs that pass are verified by their cosine in double precision.

Sorting inside cells is expressed as a join on (table, cell, bin), with bins as wide as the
window: a window reaches into the next bin at most, and Spark sorts by the join's key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelweir.llm.common import cut
from funnelweir.llm.graph import components


def collision_chance(threshold: float, bits: int, reach: float) -> float:
    """Chance that two unit vectors at the threshold meet in one table."""
    angle, apart = math.acos(threshold), math.sqrt(2 - 2 * threshold)
    return (1 - angle / math.pi) ** bits * math.erf(reach / apart / math.sqrt(2))


def tables_for(chance: float, needed: int, recall: float) -> int:
    """Tables from which a pair gets ``needed`` collisions with probability ``recall``."""
    tables = needed
    while True:
        below = sum(math.comb(tables, k) * chance**k * (1 - chance) ** (tables - k) for k in range(needed))
        if 1 - below >= recall:
            return tables
        tables += 1


def signatures(classes: DataFrame, dimension: int, tables: int, bits: int, reach: float, seed: int) -> DataFrame:
    """(class_id, sketch, cell, place): one row per class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        lines = rng.standard_normal((dimension, tables))
        signs = rng.standard_normal((dimension, tables * bits))
        powers = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimension)
                cells = ((flat @ signs) > 0).reshape(-1, tables, bits) @ powers
                n = part.num_rows
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(cells.ravel()), pa.array((flat @ lines).ravel() / reach)],
                    names=["class_id", "sketch", "cell", "place"],
                )

    return classes.select("class_id", "unit").mapInArrow(run, "class_id long, sketch int, cell long, place double")


def candidate_pairs(classes: DataFrame, dimension: int, count: int, threshold: float, recall: float, seed: int) -> DataFrame:
    """(a, b), a < b: classes that meet often enough."""
    bits = max(1, math.ceil(math.log2(max(count, 2))) - 4)
    reach = 1.645 * math.sqrt(2 - 2 * threshold)
    needed = 2
    tables = tables_for(collision_chance(threshold, bits, reach), needed, recall)
    marks = cut(signatures(classes, dimension, tables, bits, reach, seed).withColumn("bin", F.floor("place")))
    # a window reaches one bin further up; what lies below it finds the pair from the other side
    ahead = marks.select("sketch", "cell", F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"), F.col("class_id").alias("a"), F.col("place").alias("at"), F.col("bin").alias("own"))
    meets = marks.join(ahead, ["sketch", "cell", "bin"]).filter(
        (F.abs(F.col("place") - F.col("at")) <= 1) & ((F.col("own") < F.col("bin")) & (F.col("class_id") != F.col("a")) | (F.col("own") == F.col("bin")) & (F.col("a") < F.col("class_id")))
    )
    pairs = meets.select(F.least("a", "class_id").alias("a"), F.greatest("a", "class_id").alias("b"))
    return pairs.groupBy("a", "b").count().filter(F.col("count") >= needed).select("a", "b")


def links(classes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose cosine is at least the threshold."""
    left = classes.select(F.col("class_id").alias("a"), F.col("vector").alias("x"), F.col("norm").alias("x_norm"))
    right = classes.select(F.col("class_id").alias("b"), F.col("vector").alias("y"), F.col("norm").alias("y_norm"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda total, p: total + p)
    return pairs.join(left, "a").join(right, "b").filter(dot / (F.col("x_norm") * F.col("y_norm")) >= threshold).select("a", "b")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, recall: float = 0.995, seed: int = 7, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    n_links: other rows whose cosine is at least ``threshold``, equal vectors included.
    component_id: the smallest id that links reach, the row's own included; kept: the row
    has it. Vectors of another length than the most common one are compared among their
    own length. Rows with a null id link like others; their own component_id is null if no
    row of the component has an id, and they are not kept. Repeated rows count as others.
    """
    base = vectors.select(F.col(id_column).alias("id"), F.transform(F.col(vector_column), lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    base = base.withColumn("norm", norm)
    usable = F.col("norm").isNotNull() & ~F.isnan("norm") & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    base = base.withColumn("vector", F.when(usable, F.col("vector"))).withColumn("key", F.when(usable, F.xxhash64("vector")))
    rows = base.select("id", "key", "vector", "norm")
    # equal vectors share a key; the vector itself stands beside it, so equal keys of unequal vectors stay apart
    classes = rows.filter("key is not null").groupBy("key", "vector").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("norm").alias("norm"))
    classes = cut(classes.withColumn("class_id", F.xxhash64("key", "vector")).withColumn("unit", F.transform("vector", lambda x: x / F.col("norm"))))
    sizes = [(r["n"], r["count"]) for r in classes.groupBy(F.size("vector").alias("n")).count().collect()]
    found = None
    for dimension, count in sorted(sizes):
        same = classes.filter(F.size("vector") == dimension)
        one = links(same, candidate_pairs(same, dimension, count, threshold, recall, seed), threshold)
        found = one if found is None else found.union(one)
    if found is None:
        return rows.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = cut(found)
    weights = classes.select(F.col("class_id").alias("b"), "weight")
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(weights, "b").groupBy("a").agg(F.sum("weight").alias("linked"))
    labels = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = classes.select("class_id", "key", "vector", "least", "weight").join(degree.withColumnRenamed("a", "class_id"), "class_id", "left")
    placed = cut(placed.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id")))
    least = cut(placed.groupBy("component").agg(F.min("least").alias("component_id")))
    named = cut(placed.join(least, "component").select("class_id", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"))
    marked = rows.select("id", F.when(F.col("key").isNotNull(), F.xxhash64("key", "vector")).alias("class_id"))
    out = marked.filter("class_id is not null").join(named, "class_id").select("id", "n_links", "component_id")
    alone = marked.filter("class_id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
