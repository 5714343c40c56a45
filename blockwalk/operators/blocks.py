"""Seed propagation and block labels: which seed does every edge belong to?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mass
from ..functions.scores import merge_arrays, rank_key, score_array
from ..graph import Graph
from ..runtime import cut, release
from ..skew import join_small

NO_BLOCK = -1  # label of edges no seed reached


def spread_mass(
    graph: Graph, seeds: DataFrame, rounds: int, topk: int | None = None, keep: float = 1.0, fade: float | None = None
) -> DataFrame:
    """Send seed mass along out-edges for ``rounds`` rounds; returns (id, seed, score).

    Each round a vertex passes what it just received, times ``keep`` over its out-degree, to
    every out-neighbor (parallel edges each pass a share). Scores add up the untruncated
    arrivals; with ``topk`` both scores and arrivals then keep their k best seeds. ``fade``
    multiplies the old score where something arrives.

    Amounts are exact (``functions.mass``), so sums do not depend on the order in which messages
    arrive; shares are rounded down to 2^-93 of a unit. What arrives is sent on however small it
    is, also where it rounds to 0: reach does not depend on the amount.
    """
    links = graph.links("out")
    held, arrived = mass.names("s"), mass.names("i")
    some, none = F.lit(1), F.lit(0)
    start = seeds.filter(F.col("value") > 0).groupBy("seed").agg(F.max("value").alias("value"))
    start = start.join(graph.vertex_ids().withColumnRenamed("id", "seed"), "seed", "left_semi")
    amount = mass.from_double(F.col("value"))
    state = cut(start.select(
        F.col("seed").alias("id"), "seed", *[a.alias(n) for n, a in zip(held, amount, strict=True)],
        *[a.alias(n) for n, a in zip(arrived, amount, strict=True)], F.lit(True).alias("counts"), F.lit(True).alias("moves"),
    ))
    zero = F.lit(0).cast("long")
    for _ in range(rounds):
        out = [F.col(n) for n in arrived]
        out = out if keep == 1 else mass.scaled(out, keep)
        moving = state.filter("moves").select("id", "seed", *[a.alias(n) for n, a in zip(arrived, out, strict=True)])
        sent = links.join(moving, many=topk is None)
        shares = mass.divided([F.col(n) for n in arrived], F.col("out_deg"))
        come = sent.select(
            F.col("to").alias("id"), "seed", *[zero.alias(n) for n in held], *[a.alias(n) for n, a in zip(arrived, shares, strict=True)], some.alias("got")
        )
        old = state.filter("counts").select("id", "seed", *held, *[zero.alias(n) for n in arrived], none.alias("got"))
        both = come.unionByName(old).groupBy("id", "seed").agg(*[F.sum(n).alias(n) for n in (*held, *arrived)], (F.max("got") > 0).alias("moves"))
        both = both.select("id", "seed", *held, *[a.alias(n) for n, a in zip(arrived, mass.carried([F.col(n) for n in arrived]), strict=True)], "moves")
        before = [F.col(n) for n in held]
        if fade is not None:
            before = [F.when(F.col("moves"), a).otherwise(F.col(n)) for n, a in zip(held, mass.scaled(before, fade), strict=True)]
        total = mass.carried([b + F.col(n) for b, n in zip(before, arrived, strict=True)])
        updated = both.select("id", "seed", *[a.alias(n) for n, a in zip(held, total, strict=True)], *arrived, "moves")
        if topk is None:
            updated = updated.withColumn("counts", F.lit(True))
        else:
            # groups hold at most one row per seed
            ranked = updated.withColumn("score", mass.to_double([F.col(n) for n in held])).withColumn("inc", mass.to_double([F.col(n) for n in arrived]))
            by_score = Window.partitionBy("id").orderBy(rank_key("score").desc(), "seed")
            by_inc = Window.partitionBy("id").orderBy(F.desc("moves"), rank_key("inc").desc(), "seed")
            updated = (
                ranked.withColumn("counts", F.row_number().over(by_score) <= topk)
                .withColumn("moves", F.col("moves") & (F.row_number().over(by_inc) <= topk))
                .filter("counts or moves")
            )
        next_state = cut(updated.select("id", "seed", *held, *arrived, "counts", "moves"))
        release(state)
        state = next_state
        if state.filter("moves").isEmpty():
            break
    return state.filter("counts").select("id", "seed", mass.to_double([F.col(n) for n in held]).alias("score"))


def propagate(graph: Graph, seeds: DataFrame, iterations: int, topk: int) -> DataFrame:
    """Scores of every vertex for its ``topk`` best seeds; mass does not decay."""
    return spread_mass(graph, seeds, iterations, topk)


def unvisited_vertices(graph: Graph, scores: DataFrame) -> DataFrame:
    """Vertices no seed reached."""
    return graph.vertex_ids().join(scores.select("id"), "id", "left_anti")


def unvisited_edges(graph: Graph, scores: DataFrame) -> DataFrame:
    """Edges with neither end reached."""
    reached = scores.select("id").distinct().withColumn("_hit", F.lit(True))
    out = graph.edges.select("edge_id", "src", "dst")
    for end in ("src", "dst"):
        side = reached.withColumnRenamed("id", end)
        out = graph.join_end(out, end, side, "left").filter(F.col("_hit").isNull()).select("edge_id", "src", "dst")
    return out


def coverage(graph: Graph, scores: DataFrame) -> DataFrame:
    """One row: how many vertices and edges no seed reached."""
    vertices = unvisited_vertices(graph, scores).agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertices").alias("kind"), "n")
    edges = unvisited_edges(graph, scores).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "n")
    return vertices.unionByName(edges)


def edge_profiles(graph: Graph, scores: DataFrame, topk: int) -> DataFrame:
    """(edge_id, src, dst, profile): the ends' scores added per seed, best ``topk`` in order.

    The per-vertex scores travel as one array of at most k entries, and the two arrays are
    merged inside the row: edges start from the table bucketed by ``src``, move once (to the
    join on ``dst``), and no (edge, seed) rows are ever shuffled. ``scores`` must hold at most
    k rows per vertex, as ``propagate`` gives.
    """
    packed = cut(score_array(scores, "s"))
    sent = graph.links("out").with_sender(packed.withColumnRenamed("s", "s_src"))
    edges = sent.select("edge_id", F.col("at").alias("src"), F.col("to").alias("dst"), "s_src")
    edges = graph.join_end(edges, "dst", packed.select(F.col("id").alias("dst"), F.col("s").alias("s_dst")), "left")
    return edges.select("edge_id", "src", "dst", merge_arrays(F.col("s_src"), F.col("s_dst"), topk).alias("profile"))


def edge_candidates(profiles: DataFrame) -> DataFrame:
    """Profiles in long form: (edge_id, src, dst, rank, seed, score), rank 1 the best."""
    return profiles.select("edge_id", "src", "dst", F.posexplode("profile").alias("rank", "e")).select(
        "edge_id", "src", "dst", (F.col("rank") + 1).alias("rank"), "e.seed", "e.score"
    )


def assign_blocks(profiles: DataFrame) -> DataFrame:
    """(edge_id, src, dst, block, score): the best seed, or -1 with score 0."""
    best = F.get("profile", F.lit(0))
    return profiles.select(
        "edge_id", "src", "dst",
        F.coalesce(best["seed"], F.lit(NO_BLOCK)).alias("block"),
        F.coalesce(best["score"], F.lit(0.0)).alias("score"),
    )


def block_sizes(blocks: DataFrame, include_unassigned: bool = False) -> DataFrame:
    """(block, n_edges), without the -1 block unless asked for."""
    rows = blocks if include_unassigned else blocks.filter(F.col("block") != NO_BLOCK)
    return rows.groupBy("block").agg(F.count(F.lit(1)).alias("n_edges"))


def seed_distances(scores: DataFrame) -> DataFrame:
    """Score of every vertex to every seed that reached it."""
    return scores.select("id", "seed", "score")


def block_representatives(blocks: DataFrame) -> DataFrame:
    """One edge per block, the smallest (src, dst): (src, dst, seed)."""
    # two hash aggregates: a minimum over structs would sort every edge
    low = cut(blocks.groupBy("block").agg(F.min("src").alias("src")))
    among = join_small(blocks.select("block", "src", "dst"), low, low.count(), ["block", "src"], "left_semi")
    return among.groupBy("block", "src").agg(F.min("dst").alias("dst")).select("src", "dst", F.col("block").alias("seed"))
