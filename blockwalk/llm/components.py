"""Connected components of a link table, for the similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, release
from ..skew import join_unique


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id reachable.

    Alternates two contractions until nothing changes: every larger neighbour of a vertex is
    linked to the smallest of the neighbourhood, then every vertex and its smaller neighbours
    to the smallest of those. Rounds grow with the logarithm of the component. Minima are
    combined before each exchange; the joins have one row per key on one side, and a vertex
    with very many links is joined apart. The state lives in written tables, so lost executors
    cost no earlier round.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state = cut(pairs.filter("u <> v").distinct())
    mark, n = None, state.count()
    while True:
        both = state.union(state.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = state.select(F.col("u").alias("far"), F.col("v").alias("u"))
        large = join_unique(far, lowest, ["u"], at_most=n).select(F.col("far").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = join_unique(large, least, ["u"], at_most=n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut(joined.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        now = small.agg(F.count(F.lit(1)).alias("n"), total.alias("h")).first()
        release(state)
        release(large)
        state = small
        if now == mark:
            break
        mark, n = now, now["n"]
    ends = state.select(F.col("v").alias("id")).distinct()
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        ends.select("id", F.col("id").alias("component"))
    )
