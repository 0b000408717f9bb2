"""Connected components of links, without gathering them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Link a node's larger (or its smaller) neighbours to the smallest of all of its neighbours and itself."""
    both = edges.select("a", "b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b); component: the smallest node that links lead to.

    Alternates large and small stars until the links, each written to the shared folder, no
    longer change: every node then points to the smallest one.
    """
    now, mark = links.where("a != b").select("a", "b").distinct(), None
    while True:
        now = materialize(star(star(now, True), False), "stars")
        row = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def members(stars: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links that settled() has brought to the smallest ones."""
    own = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)


def drawn(edges: DataFrame, large: bool) -> DataFrame:
    """star(), by a window over each node's neighbours: less is shuffled, but a node's neighbours come to one task. Links can come more than once."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    seen = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a"))))
    out = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else seen.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("r")).select("r.*")
    return out.where("a <> b")


def settled(links: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """Links (a, b) with the same components after rounds at most, and whether every node now points to its component's smallest one."""
    now = links
    for _ in range(rounds):
        now = materialize(drawn(drawn(now, True), False).distinct(), "stars")
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("points"), F.lit(0).alias("met")).unionByName(now.select(F.col("b").alias("n"), F.lit(0).alias("points"), F.lit(1).alias("met")))
        if ends.groupBy("n").agg(F.sum("points").alias("points"), F.max("met").alias("met")).where("points > 1 or points > 0 and met > 0").isEmpty():
            return now, True
    return now, False


def around(links: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame | None:
    """The links of all that nodes (node, distinct) lead to, or None if that is not found in so many rounds."""
    reached = nodes
    for _ in range(rounds):
        two = links.join(reached.select(F.col("node").alias("a"), F.lit(True).alias("from_a")), "a", "left").join(reached.select(F.col("node").alias("b"), F.lit(True).alias("from_b")), "b", "left")
        met = materialize(two.where("from_a or from_b"), "around")
        more = met.where("from_a is null or from_b is null")
        if more.isEmpty():
            return met.select("a", "b")
        reached = materialize(reached.unionByName(met.select(F.explode(F.array("a", "b")).alias("node"))).distinct(), "reached")
    return None
