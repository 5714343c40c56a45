"""Hash partitionings of edges, as an explicit ``part`` column."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mix, pair_mix


def edge_partition_1d(edges: DataFrame, parts: int, mode: str = "xxhash64") -> DataFrame:
    """All out-edges of a source together."""
    return _place(edges, F.pmod(mix(F.col("src"), mode), F.lit(parts)))


def edge_partition_2d(edges: DataFrame, parts: int, mode: str = "xxhash64") -> DataFrame:
    """Grid over (src, dst): a vertex is in at most one row and one column of the grid. When
    ``parts`` is no square the last column of the grid is shorter."""
    side = isqrt(parts - 1) + 1 if parts > 1 else 1
    src, dst = mix(F.col("src"), mode), mix(F.col("dst"), mode)
    if side * side == parts:
        return _place(edges, F.pmod(src, F.lit(side)) * side + F.pmod(dst, F.lit(side)))
    rows = -(-parts // side)
    last = parts - rows * (side - 1)
    column = F.floor(F.pmod(src, F.lit(parts)) / rows)
    in_last = column >= side - 1
    row = F.when(in_last, F.pmod(dst, F.lit(max(last, 1)))).otherwise(F.pmod(dst, F.lit(rows)))
    return _place(edges, column * rows + row)


def random_vertex_cut(edges: DataFrame, parts: int, mode: str = "xxhash64") -> DataFrame:
    """Hash of the ordered pair: equal edges together."""
    return _place(edges, F.pmod(pair_mix(F.col("src"), F.col("dst"), mode), F.lit(parts)))


def canonical_random_vertex_cut(edges: DataFrame, parts: int, mode: str = "xxhash64") -> DataFrame:
    """Hash of the unordered pair: both directions together."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return _place(edges, F.pmod(pair_mix(low, high, mode), F.lit(parts)))


def as_loaded(edges: DataFrame) -> DataFrame:
    """Keep the partition an edge was read from."""
    if "part" not in edges.columns:
        raise ValueError("edges carry no part column: read them with read_partitioned_edges")
    return edges


STRATEGIES = {
    "canonical_random_vertex_cut": canonical_random_vertex_cut,
    "edge_partition_1d": edge_partition_1d,
    "edge_partition_2d": edge_partition_2d,
    "random_vertex_cut": random_vertex_cut,
}


def partition_by(edges: DataFrame, strategy: str, parts: int, mode: str = "xxhash64") -> DataFrame:
    return STRATEGIES[strategy](edges, parts, mode)


def _place(edges: DataFrame, part: Column) -> DataFrame:
    return edges.withColumn("part", part.cast("int"))
