"""How good is a partitioning for random walks?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import metrics, strategies, walks
from ..runtime import cut


def walk_traffic(graph: Graph, placed: DataFrame, samplings: int, steps: int, seed: int = 0, paths: DataFrame | None = None) -> DataFrame:
    """One row: replication factor, messages the walks cause, walks met outside their source's
    partition. ``paths`` reuses walks between partitionings."""
    if paths is None:
        paths = cut(walks.full_walks(graph, samplings, steps, seed))
    replicas = cut(metrics.vertex_replicas(placed))
    factor = replicas.agg(F.sum("replicas").alias("r"), F.count(F.lit(1)).alias("v")).select(
        F.try_divide(F.col("r").cast("double"), F.col("v")).alias("factor")
    ).first()["factor"]
    messages = metrics.total_messages(metrics.visit_counts(paths), replicas)
    crossing = metrics.cross_boundary_walks(paths, placed).agg(F.coalesce(F.sum("walks"), F.lit(0)).alias("crossing")).first()["crossing"]
    return messages.select(F.lit(factor).alias("factor"), "messages", F.lit(crossing).cast("long").alias("crossing"))


def compare_partitionings(graph: Graph, parts: int, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """(strategy, replicas, vertices, factor, largest) for the hash strategies and ``others``."""
    placed = {name: strategies.partition_by(graph.edges, name, parts) for name in strategies.STRATEGIES}
    placed.update(others or {})
    out = None
    for name, edges in placed.items():
        edges = edges.select("src", "dst", F.col("part").cast("long").alias("part"))
        largest = metrics.edges_per_partition(edges).agg(F.max("n_edges").alias("largest")).first()["largest"]
        row = metrics.replication_factor(edges).select(F.lit(name).alias("strategy"), "*", F.lit(largest).alias("largest"))
        out = row if out is None else out.unionByName(row)
    return out
