"""Connected components of links, by contraction in a random order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of a link (a, b); component: the smallest node reachable.

    Each round every node moves to the neighbour of least hash, if that is less than its own, and the
    links then are between the nodes moved to. The order is random, so a constant share of the nodes
    goes in each round and rounds grow with the logarithm of the nodes, whatever the shape: stars and
    chains alike. Sums combine on each task before the shuffle, and the joins cut nodes with very many
    links, or that very many nodes move to, into parts.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    total = places = None
    while left := edges.count():
        total = total or left
        best = edges.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), "b")).alias("best"), F.count("*").alias("n"))
        less = F.struct(F.col("best.h"), F.col("best.b")) < F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        moves = stored(best.select(F.col("a").alias("node"), F.when(less, F.col("best.b")).otherwise(F.col("a")).alias("root"), "n"))
        ends = lambda c, moves=moves: moves.select(F.col("node").alias(c), "n", F.col("root").alias(f"{c}_root"))
        moved = salted_join(salted_join(edges, ends("a"), "a", "b", total).drop("n"), ends("b"), "b", "a", total)
        edges = stored(moved.where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
        if places is None:
            places = moves.select("node", "root")
        else:
            held = places.groupBy("root").agg(F.count("*").alias("from"))
            further = held.join(moves.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            places = stored(salted_join(places, further, "root", "node", total, "from").select("node", F.coalesce("next", "root").alias("root")))
    if places is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = places.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("from"))
    return stored(salted_join(places, least, "root", "node", total, "from").select("node", "component"))
