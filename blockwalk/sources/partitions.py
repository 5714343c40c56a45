"""Edge sets stored one folder (or file) per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut
from ..skew import hot_keys, in_chunks, join_small, number_all, split_hot, with_slot
from .edge_lists import edges_from_lines


def write_partitioned_edges(
    edges: DataFrame, path: str, part: str = "part", mode: str = "errorifexists", hot_rows: int | None = None
) -> None:
    """Write ``src \\t dst`` text, one folder ``part=p`` per partition. Partitions too large
    for one task are written by several, as several files of the same folder."""
    # the edge id lets equal edges go to different tasks
    spread_by = [c for c in ("edge_id",) if c in edges.columns]
    rows = edges.select(F.col(part).alias("part"), "src", "dst", *spread_by)
    hot = hot_keys(rows, ["part"], hot_rows)
    if hot is None:
        placed = rows.repartition("part")
    else:
        cold = split_hot(rows, hot)[0].withColumn("slot", F.lit(0))
        placed = cold.unionByName(with_slot(rows, hot)).repartition("part", "slot").drop("slot")
    placed.select("part", "src", "dst").write.mode(mode).partitionBy("part").csv(path, sep="\t")


def read_partitioned_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, part) from ``part=`` folders."""
    return spark.read.csv(path, sep="\t", schema="src long, dst long, part int")


def read_edge_files(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, part) from a flat folder of edge files; each file is a partition, numbered
    from 0 in name order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    text = lines.select("file", F.split(F.trim("value"), r"\s+").alias("f")).filter(
        ~F.trim("value").startswith("#") & (F.size("f") >= 2)
    )
    files = cut(number_all(lines.select("file").distinct(), [F.col("file")], "part"))
    f = F.col("f")
    rows = text.select("file", f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"))
    # one row per file on the small side; beyond the broadcast bound large files are joined apart
    return join_small(rows, files, files.count(), ["file"]).select("src", "dst", F.col("part").cast("int").alias("part"))


def partition_contents(rows: DataFrame, columns: list[str], part: str = "part", chunk: int = 10_000, hot_rows: int | None = None) -> DataFrame:
    """Distinct rows of each partition, as bounded lists (part, chunk, contents)."""
    distinct = cut(rows.select(F.col(part).alias("part"), *columns).distinct())
    return in_chunks(distinct, ["part"], F.struct(*columns), [F.col(c) for c in columns], "contents", chunk, hot_rows)


__all__ = ["edges_from_lines", "partition_contents", "read_edge_files", "read_partitioned_edges", "write_partitioned_edges"]
