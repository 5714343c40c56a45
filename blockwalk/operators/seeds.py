"""Choosing seed vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, release
from ..skew import join_unique, number_all
from ..sources.seed_files import SEED_VALUE
from .relational import degrees, top_n, union_rows

_TABLES = 16  # round tables kept apart before they are written together


def top_degree_seeds(edges: DataFrame, n: int, value: float = SEED_VALUE, by: str = "degree") -> DataFrame:
    """(seed, value) of the n vertices of highest degree (``degree``, ``out_degree`` or
    ``in_degree``); of equal ones the larger ids come first."""
    best = top_n(degrees(edges), n, [F.desc(by), F.desc("id")])
    return best.select(F.col("id").alias("seed"), F.lit(float(value)).alias("value"))


def spread_seeds(edges: DataFrame, n: int, candidates: int | None = None, value: float = SEED_VALUE) -> DataFrame:
    """(seed, value, rank): vertices taken in degree order, none adjacent to one already taken.

    ``candidates`` limits the ranked list the walk goes through.
    """
    ranking = [F.desc("degree"), F.desc("id")]
    ranked = number_all(degrees(edges).select("id", "degree"), ranking, "rank", 1).select("id", "rank")
    if candidates is not None:
        # candidate lists run to millions: a range-sorted numbering, not a top-n in one task
        ranked = ranked.filter(F.col("rank") <= candidates)
    chosen = first_independent(ranked, edges.select("src", "dst"), n)
    return chosen.select(F.col("id").alias("seed"), F.lit(float(value)).alias("value"), "rank")


def first_independent(ranked: DataFrame, links: DataFrame, n: int | None = None) -> DataFrame:
    """Lexicographically first independent set of ``ranked(id, rank)`` under ``links(src, dst)``.

    The sequential rule "take the next one unless a taken one is adjacent" without a
    sequential scan: every round takes all live vertices that outrank each live neighbor and
    drops their neighbors. Stops early once the first ``n`` are certain.
    """
    ranked = cut(ranked)
    low = ranked.select(F.col("id").alias("src"), F.col("rank").alias("a"))
    high = ranked.select(F.col("id").alias("dst"), F.col("rank").alias("b"))
    # links between candidates as (better rank, worse rank), each once
    pairs = links.filter(F.col("src") != F.col("dst"))
    pairs = join_unique(join_unique(pairs, low, ["src"]), high, ["dst"])
    pairs = cut(pairs.select(F.least("a", "b").alias("better"), F.greatest("a", "b").alias("worse")).distinct())
    live = ranked.select("rank")
    won, n_pairs = [], pairs.count()
    while True:
        beaten = pairs.select(F.col("worse").alias("rank")).distinct()
        winners = cut(live.join(beaten, "rank", "left_anti"))
        won.append(winners)
        adjacent = join_unique(
            pairs, winners.withColumnRenamed("rank", "better"), ["better"], "left_semi", at_most=n_pairs
        )
        dropped = adjacent.select(F.col("worse").alias("rank")).distinct()
        next_live = cut(live.join(winners, "rank", "left_anti").join(dropped, "rank", "left_anti"))
        # the best rank still undecided; everything taken below it is final
        frontier = next_live.agg(F.min("rank").alias("r")).first()["r"]
        if frontier is None or (n is not None and union_rows(*won).filter(F.col("rank") < frontier).count() >= n):
            break
        alive = next_live.withColumnRenamed("rank", "better")
        next_pairs = join_unique(pairs, alive, ["better"], "left_semi", at_most=n_pairs)
        alive = next_live.withColumnRenamed("rank", "worse")
        next_pairs = cut(join_unique(next_pairs, alive, ["worse"], "left_semi", at_most=n_pairs))
        release(pairs)
        release(live)
        pairs, live = next_pairs, next_live
        if len(won) >= _TABLES:
            won = [cut(union_rows(*won))]
    out = ranked.join(union_rows(*won), "rank", "left_semi").select("id", "rank").orderBy("rank")
    return out if n is None else out.limit(n)
