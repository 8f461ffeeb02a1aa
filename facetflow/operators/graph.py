"""Connected components of an undirected graph by alternating large-star and small-star rounds.

Each round hangs neighbours on smaller nodes: minima are aggregated on the map side first, and only joins (whose hot keys Spark
can split) carry rows of a node. Rounds end when a round changes no edge; their number grows with the logarithm of the largest
component. Every round is written to the shared folder, so lineage stays short and lost executors cost one round.

Nodes are of any one orderable type, structs included. Null ends and loops are left out; repeated edges count once; an empty table
gives no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, dealt, discard


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _star(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """pairs (node, other): hang others, and for the small star the node itself, on the smallest of the node and its others."""
    least = pairs.groupBy("node").agg(F.min("other").alias("m")).withColumn("m", F.least("m", "node"))
    j = pairs.join(dealt(least), "node")
    if keep_larger:
        return j.where("other > node").select(F.col("other").alias("u"), F.col("m").alias("v"))
    return j.select(F.col("other").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node with an edge; component is its component's smallest node."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut(e, "components")
    before = None
    for _ in range(max_rounds):
        now = _digest(e)
        if now == before or not now[0]:
            break
        before = now
        both = e.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(e.select(F.col("v").alias("node"), F.col("u").alias("other")))
        large = _star(both, True)
        small = _star(large.select(F.col("u").alias("node"), F.col("v").alias("other")), False)
        new = cut(small.where(F.col("u") != F.col("v")).distinct(), "components")
        discard(e)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
