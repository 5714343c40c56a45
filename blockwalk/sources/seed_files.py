"""Seed, hub and landmark files: ``id \\t value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..skew import number_all

# fixed value: mass a seed starts with when the file gives none
SEED_VALUE = 100000.0


def seeds_from_lines(lines: DataFrame, value: float = SEED_VALUE, *more: str) -> DataFrame:
    """Lines to (seed, value, *more columns); lines with an id only get ``value``."""
    f = F.split(F.trim("value"), "\t")
    return lines.filter(F.trim("value") != "").select(
        F.trim(f[0]).cast("long").alias("seed"),
        F.coalesce(F.trim(F.get(f, F.lit(1))).cast("double"), F.lit(value)).alias("value"),
        *more,
    )


def read_seeds(spark: SparkSession, path: str, value: float = SEED_VALUE) -> DataFrame:
    """(seed, value, rank): ``rank`` is the seed's place in the file (files in name order), which
    residual filling follows."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    placed = number_all(lines.filter(F.trim("value") != ""), [F.col("_file"), F.col("_at")], "rank")
    return seeds_from_lines(placed, value, "rank")


def write_seeds(seeds: DataFrame, path: str, mode: str = "errorifexists") -> None:
    seeds.select("seed", F.coalesce("value", F.lit(SEED_VALUE)).alias("value")).write.mode(mode).csv(path, sep="\t")
