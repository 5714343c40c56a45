"""Degrees, neighbors, triplets, vertex joins and edge-set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..skew import in_chunks, number_all

DIRECT_ROWS = 10_000  # rows that one task may merge


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree) of every vertex with an edge, in one pass."""
    end = F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    ))
    return (
        edges.select(end.alias("e"))
        .groupBy(F.col("e.id").alias("id"))
        .agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
        .withColumn("degree", F.col("out_degree") + F.col("in_degree"))
    )


def neighbors(edges: DataFrame, direction: str = "out", chunk: int = 10_000, hot_rows: int | None = None) -> DataFrame:
    """Neighbor id lists (id, chunk, neighbors), sorted; lists longer than ``chunk`` continue
    in the next chunk."""
    at, to = ("src", "dst") if direction == "out" else ("dst", "src")
    ids = [c for c in ("edge_id",) if c in edges.columns]
    rows = edges.select(F.col(at).alias("id"), F.col(to).alias("to"), *ids)
    return in_chunks(rows, ["id"], F.col("to"), [F.col(c) for c in ("to", *ids)], "neighbors", chunk, hot_rows)


def in_edges(edges: DataFrame, columns: list[str] | None = None, chunk: int = 10_000, hot_rows: int | None = None) -> DataFrame:
    """Whole incoming edges per vertex as (id, chunk, edges)."""
    columns = columns or edges.columns
    rows = edges.select(F.col("dst").alias("id"), F.struct(*columns).alias("edge"))
    return in_chunks(rows, ["id"], F.col("edge"), [F.col("edge")], "edges", chunk, hot_rows)


def triplets(graph: Graph, attributes: list[str]) -> DataFrame:
    """Edges with the attributes of both ends as src_<name> and dst_<name>.

    Edges without columns of their own come from the table bucketed by ``src``: they move once,
    to the join on ``dst``."""
    side = {end: graph.vertices.select(F.col("id").alias(end), *[F.col(a).alias(f"{end}_{a}") for a in attributes]) for end in ("src", "dst")}
    if set(graph.edges.columns) == {"edge_id", "src", "dst"}:
        sent = graph.links("out").with_sender(side["src"].withColumnRenamed("src", "id"))
        out = sent.withColumnsRenamed({"at": "src", "to": "dst"}).drop("out_deg")
    else:
        out = graph.join_end(graph.edges, "src", side["src"], "left")
    return graph.join_end(out, "dst", side["dst"], "left")


def attach(vertices: DataFrame, values: DataFrame, defaults: dict) -> DataFrame:
    """Left join of vertex values; vertices without one get the default."""
    joined = vertices.join(values.select("id", *defaults), "id", "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(d)) for n, d in defaults.items()})


def union_with_defaults(vertices: DataFrame, values: DataFrame, defaults: dict) -> DataFrame:
    """Vertices that dropped out of an aggregate come back with defaults; real values win."""
    return attach(vertices.select("id").distinct(), values, defaults)


def map_vertices(graph: Graph, **columns: Column) -> Graph:
    return Graph(graph.vertices.withColumns(columns), graph.edges, graph.hot_rows)


def map_edges(graph: Graph, **columns: Column) -> Graph:
    return Graph(graph.vertices, graph.edges.withColumns(columns), graph.hot_rows)


def map_triplets(graph: Graph, attributes: list[str], **columns: Column) -> Graph:
    """New edge columns computed from the edge and the attributes of both ends."""
    wide = triplets(graph, attributes).withColumns(columns)
    kept = [*graph.edges.columns, *[c for c in columns if c not in graph.edges.columns]]
    return Graph(graph.vertices, wide.select(*kept), graph.hot_rows)


def filter_vertices(graph: Graph, condition: Column) -> DataFrame:
    return graph.vertices.filter(condition)


def filter_edges(graph: Graph, condition: Column) -> DataFrame:
    return graph.edges.filter(condition)


def join_by_id(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "id")


def select_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The edges named by ``chosen(edge_id)``."""
    return edges.join(chosen.select("edge_id"), "edge_id", "left_semi")


def subtract_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges not named by ``removed(edge_id)``; equal (src, dst) pairs stay distinct."""
    return edges.join(removed.select("edge_id"), "edge_id", "left_anti")


def union_rows(*parts: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


union_edges = union_rows


def set_sizes(members: DataFrame, a: Column, b: Column) -> DataFrame:
    """Sizes of two vertex sets' intersection and union; ``members`` holds (block, id)."""
    sides = members.filter(a | b).groupBy("id").agg(F.max(a).alias("in_a"), F.max(b).alias("in_b"))
    return sides.agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("shared"), F.count(F.lit(1)).alias("united")
    )


def reduce_by_key(rows: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def counters(graph: Graph) -> DataFrame:
    """(counter, value): rows, loops and id sums of a graph's edge and vertex tables."""
    edges = graph.edges.agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"),
        F.coalesce(F.sum("src"), F.lit(0)).alias("src_sum"), F.coalesce(F.sum("dst"), F.lit(0)).alias("dst_sum"),
    )
    vertices = graph.vertices.agg(F.count(F.lit(1)).alias("vertices"), F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum"))
    long = [t.unpivot([], t.columns, "counter", "value") for t in (edges, vertices)]
    return long[0].unionByName(long[1])


def top_n(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Global top-n. Up to ``DIRECT_ROWS`` each task keeps n rows and one merges them; more are
    cut off by their number in a range-sorted table, so no task holds n rows."""
    if n <= DIRECT_ROWS:
        return rows.orderBy(*order).limit(n)
    return number_all(rows, order, "_place", 1, total=False).filter(F.col("_place") <= n).drop("_place")


def explode_scores(rows: DataFrame, scores: str, fallback: int = -1) -> DataFrame:
    """One row per entry of an array column of (seed, score), plus one fallback row."""
    spare = F.array(F.struct(F.lit(fallback).cast("long").alias("seed"), F.lit(0.0).alias("score")))
    kept = [c for c in rows.columns if c != scores]
    return rows.select(*kept, F.explode(F.concat(F.col(scores), spare)).alias("e")).select(*kept, "e.seed", "e.score")


def per_partition(edges: DataFrame, part: str = "part", **aggregates: Column) -> DataFrame:
    """Aggregates over the explicit partition column."""
    return edges.groupBy(part).agg(*[c.alias(n) for n, c in aggregates.items()])
