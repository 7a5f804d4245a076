"""Connected components of a large graph as a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in edges (a, b), a row for each node.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to its smallest one (large star),
    then its smaller neighbours (small star). Stars are all that is left. Each step groups by node; a hub's neighbours are
    joined to its minimum rather than collected, and every round is written to the shared folder.
    """
    links = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    links = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = links.select("a").union(links.select("b")).distinct()
    state = None
    for _ in range(MOST_ROUNDS):
        both = links.union(links.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        small = large.select("b", "a").toDF("u", "v")  # a < b: every v is a smaller neighbour of u
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        kept = small.join(least, "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("u").alias("b")), F.struct(F.col("m").alias("a"), F.col("v").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        links = materialise(kept, "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(25,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    star = links.groupBy("b").agg(F.min("a").alias("component"))
    return nodes.join(star, nodes["a"] == star["b"], "left").select(F.col("a").alias("node"), F.coalesce("component", "a").alias("component"))
