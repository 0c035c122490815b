"""Connected components without collecting anything: alternating large-star and small-star steps.

Each step is one aggregation with map-side combine (the smallest neighbour of a node) and one equi-join that
adaptive execution can split where a node has very many neighbours. The edge table is written to the shared folder
after each round, so a lost executor never costs more than one round. The number of rounds grows with the logarithm
of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

_ROUNDS = 100


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of u with the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links u and each smaller neighbour of u with the smallest of them."""
    least = _smallest(edges)
    return edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    x = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return x.n, x.s


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (u, v); component is the smallest node reachable.

    Loops, repeated edges and edges with a null end don't count. Nodes without edges aren't in the result.
    """
    edges = keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = _mark(edges)
    if last[0]:
        for _ in range(_ROUNDS):
            edges = keep(_small_star(_large_star(edges)).distinct(), "edges")
            now = _mark(edges)
            if now == last:
                break
            last = now
        else:
            raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
