"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelweir.llm.common import cut

#: Rows of one node are dealt out to so many tasks.
SALTS = 16


def with_least(pairs: DataFrame) -> DataFrame:
    """Rows (u, v) with ``least``, the smallest v of the same u.

    A node with a large share of the edges is spread by a hash of v: its minimum is taken
    for each share, then over the at most ``SALTS`` shares, then returned to each share.
    The rows themselves are shuffled once.
    """
    salted = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("share")).repartition("u", "share")
    shares = salted.groupBy("u", "share").agg(F.min("v").alias("least"))
    back = shares.withColumn("least", F.min("least").over(Window.partitionBy("u")))
    return salted.join(back, ["u", "share"]).select("u", "v", "least")


def edges_of(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """Each row's edges (u, v) between the named columns, without loops."""
    both = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])
    return rows.select(F.explode(both).alias("e")).select("e.u", "e.v").filter("u <> v")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge (u, v); component: the smallest node it reaches.

    Large-star and small-star steps alternate until the edges no longer change; the number
    of rounds grows with the logarithm of a component's diameter. Each round is a
    checkpoint, and only a count and a checksum reach the driver. An empty table of edges
    gives an empty table. Raises if the rounds do not suffice.
    """
    at = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        stars = with_least(edges_of(at, ("u", "v"), ("v", "u"))).filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        inner = with_least(stars)
        at = cut(edges_of(inner, ("v", "least"), ("u", "least")).distinct())
        row = at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == state:
            roots = at.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        state = tuple(row)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
