"""From a graph and seeds to an edge partitioning, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import balance, blocks
from ..runtime import cut
from ..skew import join_small

METHODS = ("blocks", "capped", "reschedule", "lpt", "overlap")


@dataclass
class Labels:
    """What seed propagation yields; every table is materialised once."""

    scores: DataFrame  # id, seed, score
    profiles: DataFrame  # edge_id, src, dst, profile
    blocks: DataFrame  # edge_id, src, dst, block, score


def label_blocks(graph: Graph, seeds: DataFrame, iterations: int, topk: int) -> Labels:
    scores = cut(blocks.propagate(graph, seeds, iterations, topk))
    profiles = cut(blocks.edge_profiles(graph, scores, topk))
    return Labels(scores, profiles, cut(blocks.assign_blocks(profiles)))


def partition_edges(
    graph: Graph, seeds: DataFrame, iterations: int, topk: int, method: str = "lpt", parts: int | None = None,
    inter_fac: float = 0.15, share: float = 0.1, labels: Labels | None = None,
) -> DataFrame:
    """(edge_id, src, dst, part) of every edge.

    ``blocks``: one partition per seed as labeled, -1 for edges no seed reached.
    ``capped`` / ``reschedule``: one partition per seed of at most E div S + 1 edges.
    ``lpt`` / ``overlap``: blocks merged into ``parts`` partitions by size, or by shared
    vertices; edges without a block level the sizes.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    labels = label_blocks(graph, seeds, iterations, topk) if labels is None else labels
    if method in ("lpt", "overlap"):
        if parts is None:
            raise ValueError(f"{method} needs the number of partitions")
        sizes = cut(blocks.block_sizes(labels.blocks))
        if method == "lpt":
            merge = balance.merge_blocks_lpt(sizes, parts)
        else:
            merge = balance.merge_blocks_overlap(sizes, balance.block_vertices(labels.blocks), parts, inter_fac)
        residual = labels.blocks.filter(F.col("block") == blocks.NO_BLOCK).count()
        quotas = balance.water_fill(balance.part_sizes(sizes, merge), residual)
        return balance.materialize_partitions(labels.blocks, merge, quotas)
    assigned = labels.blocks.select("edge_id", "src", "dst", "block")
    ids = sorted(r["seed"] for r in balance.block_rows(seeds, "seed"))
    if method != "blocks":
        cap = balance.default_cap(labels.profiles.count(), len(ids))
        if method == "capped":
            assigned = balance.capped_assign(labels.profiles, seeds, cap)
        else:
            assigned = balance.partial_reschedule(labels.profiles, seeds, cap, share)
        assigned = balance.fill_residual(assigned, seeds, cap)
    index = graph.edges.sparkSession.createDataFrame([(s, i) for i, s in enumerate(ids)], "block long, part int")
    placed = join_small(assigned, index, len(ids), ["block"], "left")
    return placed.select("edge_id", "src", "dst", F.coalesce("part", F.lit(blocks.NO_BLOCK)).alias("part"))
