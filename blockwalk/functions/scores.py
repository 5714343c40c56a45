"""Ranking rule and score maps.

Seed scores come from exact sums (``mass``), so they are the same whatever the order of the terms,
and are compared as they are. Ties go to the smaller seed (or edge id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_ENTRIES = "array<struct<seed:bigint,score:double>>"


def rank_key(score: str = "score") -> Column:
    return F.col(score)


def top_k(df: DataFrame, k: int, keys: list[str], score: str = "score", tie: str = "seed", rank: str | None = None) -> DataFrame:
    """The k best rows per key; the partial group limit trims each task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(rank_key(score).desc(), F.col(tie).asc())
    best = df.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
    return best.drop("_place") if rank is None else best.withColumnRenamed("_place", rank)


def score_array(df: DataFrame, out: str = "scores") -> DataFrame:
    """(id, seed, score) rows to one ordered array of (seed, score) per id. For frames already
    cut to k rows per id."""
    entry = F.struct((-rank_key()).alias("key"), "seed", "score")
    ordered = F.sort_array(F.collect_list(entry))
    return df.groupBy("id").agg(F.transform(ordered, _seed_score).alias(out))


def _seed_score(entry: Column) -> Column:
    return F.struct(entry["seed"].alias("seed"), entry["score"].alias("score"))


def score_map(df: DataFrame, out: str = "scores") -> DataFrame:
    """(id, seed, score) rows to one map per id, for output in map form."""
    return df.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("seed", "score")))).alias(out))


def map_add(a: Column, b: Column) -> Column:
    """Key-wise sum of two score maps."""
    zero = F.lit(0.0)
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def map_scale(m: Column, by: Column) -> Column:
    return F.transform_values(m, lambda _, v: v / by)


def map_without(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def merge_arrays(a: Column, b: Column, k: int) -> Column:
    """Key-wise sum of two (seed, score) arrays, best k in rank order; stays in the row."""
    def as_map(entries):
        return F.map_from_entries(F.coalesce(entries, F.array().cast(_ENTRIES)))

    summed = F.map_entries(map_add(as_map(a), as_map(b)))
    keyed = F.transform(
        summed,
        lambda e: F.struct((-e["value"]).alias("key"), e["key"].alias("seed"), e["value"].alias("score")),
    )
    merged = F.transform(F.slice(F.sort_array(keyed), 1, k), _seed_score)
    # where one end has no scores the other's are the sum, in order already
    return F.when(a.isNull(), F.slice(F.coalesce(b, F.array().cast(_ENTRIES)), 1, k)).when(b.isNull(), F.slice(a, 1, k)).otherwise(merged)
