"""Neighbourhood composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweft.functions import arrays as A
from cellweft.operators.graph import both_ways, hops, simple_edges


def composition(members: DataFrame, nodes: DataFrame, weight: str | None = None) -> DataFrame:
    """(id, type_ix, n): summed weight of the types among the members (src, dst) of each environment."""
    w = F.col(weight) if weight else F.lit(1)
    m = members.join(nodes.select(F.col("id").alias("dst"), "type_ix", *([weight] if weight and weight in nodes.columns and weight not in members.columns else [])), "dst")
    return m.groupBy(F.col("src").alias("id"), "type_ix").agg(F.sum(w).alias("n"))


def graph_environment(edges: DataFrame, nodes: DataFrame, order: int) -> DataFrame:
    """Types within `order` steps, the node included, weighted by node_size."""
    return composition(hops(edges, nodes, order), nodes, "node_size")


def group_environment(nodes: DataFrame, group: str) -> DataFrame:
    """Types of each group: (group, type_ix, n)."""
    return nodes.groupBy(group, "type_ix").agg(F.count(F.lit(1)).alias("n"))


def knn_environment(knn: DataFrame, nodes: DataFrame, width: float | None = None) -> DataFrame:
    """Types among the neighbours of a (src, dst, dist, rank) table; with a width, weighted by a Gaussian scaled to the sixth neighbour counted from the point itself."""
    if width is None:
        return composition(knn, nodes)
    sixth = knn.filter(F.col("rank") == 6).select("src", F.col("dist").alias("_d"))
    scaled = knn.join(sixth, "src").withColumn("_w", F.exp(-F.pow(F.col("dist") / (F.col("_d") * width), 2)))
    return composition(scaled, nodes, "_w")


def environment_shares(env: DataFrame) -> DataFrame:
    return env.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("id")))


def environment_entropy(env: DataFrame) -> DataFrame:
    """(id, h): base-2 entropy of each environment."""
    return environment_shares(env).groupBy("id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"))


def environment_vector(env: DataFrame, types: int) -> DataFrame:
    """(id, vec): counts by type index as an array."""
    return env.groupBy("id").agg(F.array(*[F.sum(F.when(F.col("type_ix") == t, F.col("n")).otherwise(0)).cast("double") for t in range(types)]).alias("vec"))


def local_abundance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, type_ix, p): shares of the types of the neighbours; nodes without a neighbour have none."""
    return environment_shares(composition(both_ways(simple_edges(edges)), nodes))


def environment_distance(env: DataFrame, types: int) -> DataFrame:
    """env vectors as shares, for divergences between environments."""
    v = environment_vector(env, types)
    return v.withColumn("vec", F.transform("vec", lambda x: x / A.total(F.col("vec"))))
