"""Result tables: seed distances, block representatives and vertex results.

The long parquet form is the working format; the one-line-per-vertex text forms
``(4,Map(10 -> 1.1, 1 -> 4.8))`` and ``((12,13),-1)`` are read and written for exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed patterns of the text forms
_DISTANCE = r"^\((-?\d+),Map\((.*)\)\)$"
MAX_LIST = 10_000  # entries of one text line
_REPRESENTATIVE = r"^\(\((-?\d+),(-?\d+)\),(-?\d+)\)$"


def seed_distances_from_lines(lines: DataFrame) -> DataFrame:
    """Text lines to (id, seed, score)."""
    text = F.trim("value")
    pairs = F.explode(F.split(F.regexp_extract(text, _DISTANCE, 2), r",\s*"))
    pair = F.split("pair", r"\s*->\s*")
    return (
        lines.filter(text.rlike(_DISTANCE))
        .select(F.regexp_extract(text, _DISTANCE, 1).cast("long").alias("id"), pairs.alias("pair"))
        .filter(F.col("pair") != "")
        .select("id", pair[0].cast("long").alias("seed"), pair[1].cast("double").alias("score"))
    )


def seed_distances_to_lines(distances: DataFrame, longest: int = MAX_LIST) -> DataFrame:
    """(id, seed, score) to text lines, one per id. The form has no way to continue a list, so an
    id with more than ``longest`` rows is an error; such tables are kept in the long form."""
    counts = distances.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if not counts.filter(F.col("n") > longest).isEmpty():
        raise ValueError(f"a vertex has more than {longest} seeds; write the long form")
    entry = F.concat(F.col("seed").cast("string"), F.lit(" -> "), F.col("score").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("seed", entry.alias("text"))))
    return distances.groupBy("id").agg(listed.alias("l")).select(
        F.concat(F.lit("("), F.col("id").cast("string"), F.lit(",Map("), F.array_join("l.text", ", "), F.lit("))")).alias("value")
    )


def block_representatives_from_lines(lines: DataFrame) -> DataFrame:
    """Text lines to (src, dst, seed)."""
    text = F.trim("value")
    return lines.filter(text.rlike(_REPRESENTATIVE)).select(
        *[F.regexp_extract(text, _REPRESENTATIVE, i).cast("long").alias(n) for i, n in enumerate(["src", "dst", "seed"], 1)]
    )


def block_representatives_to_lines(representatives: DataFrame) -> DataFrame:
    return representatives.select(F.format_string("((%d,%d),%d)", "src", "dst", "seed").alias("value"))


def write_seed_distances(distances: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    if form == "text":
        seed_distances_to_lines(distances).write.mode(mode).text(path)
    else:
        distances.select("id", "seed", "score").write.mode(mode).parquet(path)


def read_seed_distances(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    if form == "text":
        return seed_distances_from_lines(spark.read.text(path))
    return spark.read.schema("id long, seed long, score double").parquet(path)


def write_block_representatives(representatives: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    if form == "text":
        block_representatives_to_lines(representatives).write.mode(mode).text(path)
    else:
        representatives.select("src", "dst", "seed").write.mode(mode).parquet(path)


def read_block_representatives(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    if form == "text":
        return block_representatives_from_lines(spark.read.text(path))
    return spark.read.schema("src long, dst long, seed long").parquet(path)


def save_vertices(vertices: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a vertex result; ``form`` is any file format Spark writes (parquet, json, orc)."""
    vertices.write.mode(mode).format(form).save(path)


def sample_vertices(vertices: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Bernoulli sample of a result before saving."""
    return vertices.sample(False, fraction, seed)
