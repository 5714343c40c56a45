"""Graphs derived from the driver tables, shared by queries, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwalk import Graph, build_graph, cut, with_edge_ids
from blockwalk.skew import lead_within

# co-purchase chains: consecutive different parts of an order. All queries read ``chain``, the whole
# table with its parallel edges; the benchmark also has each pair once, a smaller graph, and the
# whole table with one vertex (``HUB``) as the source of a third of all edges
CHAINS = {"chain": "true", "dense": "true", "returned": "l_returnflag = 'R'", "hub": "true"}
HUB = 1
ORDER_SHIFT = 1_000_000_000
# graphs are laid out once per session and data folder; queries start from the laid-out tables
_known: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget() -> None:
    _known.clear()


def once(spark: SparkSession, sf_dir: str, name: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _known:
        _known[key] = make()
    return _known[key]


def chain(spark: SparkSession, sf_dir: str, variant: str = "chain") -> Graph:
    def make():
        lines = table(spark, sf_dir, "lineitem").filter(CHAINS[variant])
        lines = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
        # ties in line number are equal parts, so the order is total
        steps = lead_within(lines, ["l_orderkey"], [F.col("l_linenumber"), F.col("src")], "src", "dst")
        if variant == "hub":
            steps = steps.withColumn("src", F.when(F.col("l_orderkey") % 3 == 0, F.lit(HUB).cast("long")).otherwise(F.col("src")))
        pairs = steps.filter("src <> dst").select("src", "dst")
        once_each = variant not in ("chain", "hub")
        graph = build_graph(cut(with_edge_ids(pairs.distinct() if once_each else pairs, distinct=once_each)))
        return Graph(cut(graph.vertices), graph.edges)

    return once(spark, sf_dir, variant, make)


def customer_orders(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders and their customers: one component per customer. Order ids are shifted."""

    def make():
        pairs = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + ORDER_SHIFT).alias("src"), F.col("o_custkey").alias("dst"))
        graph = build_graph(cut(with_edge_ids(pairs)))
        return Graph(cut(graph.vertices), graph.edges)

    return once(spark, sf_dir, "customer_orders", make)


def topic_chain(spark: SparkSession, sf_dir: str, variant: str = "chain") -> Graph:
    """The chain with the followed part's type as its edges' topic."""

    def make():
        graph = chain(spark, sf_dir, variant)
        types = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst"), F.array("p_type").alias("topics"))
        return Graph(graph.vertices, cut(graph.join_end(graph.edges, "dst", types)))

    return once(spark, sf_dir, f"topic_{variant}", make)


def buyer_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, topics): customers and the suppliers they bought from, with part types;
    suppliers are shifted into their own id range."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    bought = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return bought.groupBy(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).agg(
        F.sort_array(F.collect_set("p_type")).alias("topics")
    )
