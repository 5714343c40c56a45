"""Edge list readers. Each ``*_from_lines`` takes a frame with one string column ``value``,
as ``spark.read.text`` gives it, so the same parser serves files and derived lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..skew import join_unique


def _fields(lines: DataFrame, at_least: int) -> DataFrame:
    """Whitespace-separated fields of data lines; comments, blank and short lines are dropped."""
    text = F.trim("value")
    return (
        lines.filter((text != "") & ~text.startswith("#"))
        .select(F.split(text, r"\s+").alias("f"))
        .filter(F.size("f") >= at_least)
    )


def edges_from_lines(lines: DataFrame) -> DataFrame:
    """``src dst`` lines to (src, dst)."""
    f = F.col("f")
    return _fields(lines, 2).select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"))


def attr_edges_from_lines(lines: DataFrame) -> DataFrame:
    """``src attr dst`` lines to (src, attr, dst)."""
    f = F.col("f")
    return _fields(lines, 3).select(
        f[0].cast("long").alias("src"), f[1].alias("attr"), f[2].cast("long").alias("dst")
    )


def labeled_edges_from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``name attr name`` lines to (vertices(id, name), edges(src, attr, dst)).

    Ids are 64-bit hashes of the names; a dictionary of the distinct names keeps the name as
    vertex attribute, and two names sharing an id are an error rather than a merged vertex.
    """
    f = F.col("f")
    named = _fields(lines, 3).select(f[0].alias("src_name"), f[1].alias("attr"), f[2].alias("dst_name"))
    names = named.select(F.col("src_name").alias("name")).union(named.select("dst_name")).distinct()
    vertices = names.select(F.xxhash64("name").alias("id"), "name")
    # the check rides on the dictionary: min and max name differ only if two names share an id
    vertices = vertices.groupBy("id").agg(F.min("name").alias("name"), F.max("name").alias("_other"))
    clash = F.concat(F.lit("two names share one id: "), F.col("name"), F.lit(", "), F.col("_other"))
    vertices = vertices.select(
        "id", F.when(F.col("name") == F.col("_other"), F.col("name")).otherwise(F.raise_error(clash)).alias("name")
    )
    edges = named.select(F.xxhash64("src_name").alias("src"), "attr", F.xxhash64("dst_name").alias("dst"))
    return vertices, edges


def topic_edges_from_lines(lines: DataFrame) -> DataFrame:
    """``src \\t dst \\t t1,t2,...`` lines to (src, dst, topics array)."""
    f = F.col("f")
    text = F.trim("value")
    return (
        lines.filter((text != "") & ~text.startswith("#"))
        .select(F.split("value", "\t").alias("f"))
        .filter(F.size("f") >= 3)
        .select(
            F.trim(f[0]).cast("long").alias("src"),
            F.trim(f[1]).cast("long").alias("dst"),
            F.transform(F.split(f[2], ","), lambda t: F.trim(t)).alias("topics"),
        )
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return edges_from_lines(spark.read.text(path))


def read_attr_edges(spark: SparkSession, path: str) -> DataFrame:
    return attr_edges_from_lines(spark.read.text(path))


def read_labeled_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return labeled_edges_from_lines(spark.read.text(path))


def read_topic_edges(spark: SparkSession, path: str) -> DataFrame:
    return topic_edges_from_lines(spark.read.text(path))


def name_edges(edges: DataFrame, vertices: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Edges of a labeled graph with the names of both ends."""
    names = vertices.select("id", "name")
    out = join_unique(edges, names.select(F.col("id").alias("src"), F.col("name").alias("src_name")), ["src"], hot_rows=hot_rows)
    return join_unique(out, names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), ["dst"], hot_rows=hot_rows)
