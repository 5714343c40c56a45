"""Partition quality and walk traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from ..skew import BROADCAST_ROWS, in_chunks, join_small, join_spread, join_unique, number_within


def partition_vertices(edges: DataFrame, part: str = "part") -> DataFrame:
    """Distinct (part, id): the vertices with an edge in each partition."""
    return edges.select(F.col(part).alias("part"), F.explode(F.array("src", "dst")).alias("id")).distinct()


def replication_factor(edges: DataFrame, part: str = "part") -> DataFrame:
    """One row: replicas, vertices, factor = replicas / vertices."""
    per_vertex = vertex_replicas(edges, part)
    sums = per_vertex.agg(F.sum("replicas").alias("replicas"), F.count(F.lit(1)).alias("vertices"))
    return sums.withColumn("factor", F.try_divide(F.col("replicas").cast("double"), F.col("vertices")))


def vertex_replicas(edges: DataFrame, part: str = "part") -> DataFrame:
    """(id, replicas): partitions holding an edge of the vertex."""
    return partition_vertices(edges, part).groupBy("id").agg(F.count(F.lit(1)).alias("replicas"))


def edges_per_partition(edges: DataFrame, part: str = "part") -> DataFrame:
    return edges.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("n_edges"))


def num_partitions(edges: DataFrame, part: str = "part") -> DataFrame:
    return edges.agg(F.count_distinct(F.col(part)).alias("n_parts"))


def visit_counts(walks: DataFrame) -> DataFrame:
    """(id, visits): how often each vertex lies on a path; sink markers do not count."""
    hops = walks.select(F.explode("path").alias("id")).filter(F.col("id") != -1)
    return hops.groupBy("id").agg(F.count(F.lit(1)).alias("visits"))


def total_messages(visits: DataFrame, replicas: DataFrame) -> DataFrame:
    """One row: sum of visits times replicas."""
    return visits.join(replicas, "id").agg(F.coalesce(F.sum(F.col("visits") * F.col("replicas")), F.lit(0)).alias("messages"))


def walks_by_source(walks: DataFrame) -> DataFrame:
    """(id, source, n): where the walks now at each vertex came from."""
    return walks.groupBy(F.col("current").alias("id"), "source").agg(F.count(F.lit(1)).alias("n"))


def walk_sources(walks: DataFrame, chunk: int = 10_000, hot_rows: int | None = None) -> DataFrame:
    """The same as bounded id lists (id, chunk, sources), one entry per walk."""
    rows = walks.select(F.col("current").alias("id"), "source", "walk")
    return in_chunks(rows, ["id"], F.col("source"), [F.col("source"), F.col("walk")], "sources", chunk, hot_rows)


def cross_boundary_walks(walks: DataFrame, edges: DataFrame, part: str = "part", hot_rows: int | None = None) -> DataFrame:
    """(part, walks): per partition, walks met at the ends of its edges whose source vertex is
    not in the partition.

    All meetings less those whose source lies inside. The first need one row per (partition,
    vertex); the second start from the walks, each copied to the partitions of its source and
    looked up there at the vertex it is at. So rows formed are places and walks times the
    replicas of their sources, never a hub's walks times its partitions.
    """
    ends = edges.select(F.col(part).alias("part"), F.explode(F.array("src", "dst")).alias("id"))
    places = cut(ends.groupBy("part", "id").agg(F.count(F.lit(1)).alias("n_ends")))
    n_places = places.count()
    present = cut(walks_by_source(walks).withColumnRenamed("id", "at"))
    here = present.groupBy(F.col("at").alias("id")).agg(F.sum("n").alias("n"))
    met = join_unique(places, here, ["id"], hot_rows=hot_rows, at_most=n_places).groupBy("part").agg(F.sum(F.col("n") * F.col("n_ends")).alias("w"))
    # a source has a row per vertex its walks are at, and one per partition it lies in
    homes = join_spread(present, places.select(F.col("id").alias("source"), "part"), ["source"], hot_rows)
    inside = join_unique(homes, places.withColumnRenamed("id", "at"), ["part", "at"], hot_rows=hot_rows)
    inside = inside.groupBy("part").agg(F.sum(F.col("n") * F.col("n_ends")).alias("i"))
    left = F.col("w") - F.coalesce("i", F.lit(0))
    return met.join(inside, "part", "left").select("part", left.alias("walks")).filter("walks > 0")


def partition_seeds(edges: DataFrame, representatives: DataFrame, part: str = "part") -> DataFrame:
    """(part, seed): the seed whose representative edge lies in the partition."""
    placed = edges.select("src", "dst", F.col(part).alias("part"))
    held = join_small(placed, representatives, representatives.count(), ["src", "dst"])
    return held.select("part", "seed").distinct()


def visits_by_distance(
    visits: DataFrame, distances: DataFrame, edges: DataFrame, representatives: DataFrame, precision: int,
    part: str = "part", hot_rows: int | None = None,
) -> DataFrame:
    """(part, seed, bin, mean_visits, n): visited vertices of a partition by score to its seed
    descending, in groups of max(1, n div precision), with the mean visits of each group.

    Partitions are ranked with ``number_within``, so one holding a third of all vertices is
    ranked by many tasks.
    """
    seeds = cut(partition_seeds(edges, representatives, part).filter(F.col("seed") != -1))
    few = seeds.count() <= BROADCAST_ROWS
    if few:
        # edges of partitions without a seed are left where they are
        edges = edges.join(F.broadcast(seeds.select(F.col("part").alias(part)).distinct()), part, "left_semi")
    inside = partition_vertices(edges, part)  # a partition may have several seeds
    inside = (inside.join(F.broadcast(seeds), "part") if few else join_spread(inside, seeds, ["part"], hot_rows)).join(visits, "id")
    scored = inside.join(distances.select("id", "seed", "score"), ["id", "seed"], "left")
    scored = cut(scored.withColumn("score", F.coalesce("score", F.lit(0.0))))
    placed = number_within(
        scored.withColumn("_key", F.col("score")), ["part", "seed"], [F.desc("_key"), F.asc("id")], "_n", hot_rows
    )
    size = scored.groupBy("part", "seed").agg(F.count(F.lit(1)).alias("_all"))
    grouped = join_unique(placed, size, ["part", "seed"], hot_rows=hot_rows)
    width = F.expr(f"greatest(1, _all div {precision})")
    return (
        grouped.withColumn("_width", width)
        .withColumn("bin", F.expr("(_n - 1) div _width"))
        .groupBy("part", "seed", "bin")
        .agg(F.avg("visits").alias("mean_visits"), F.count(F.lit(1)).alias("n"))
    )
