"""Reproducible random walks.

A walk is a row (source, walk, step, current). Every step joins the walks to the degree of the
vertex they are at, then to the one edge row (current, idx) they drew, so walks at a hub spread over
its neighbors; where many walks are at one vertex or draw the same edge, bounded broadcasts answer
them. The edges carry no degrees and move once, when they are laid out by (src, idx). Paths are put
together at the end, from the log of hops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draw
from ..graph import Graph
from ..runtime import bucket_count, cut, cut_bucketed
from ..skew import hot_keys, in_chunks, join_beside, join_unique, number_within, split_hot
from .relational import union_rows

NO_NEIGHBOR = -1


def indexed_neighbors(edges: DataFrame, hot_rows: int | None = None, at_most: int | None = None) -> DataFrame:
    """(src, idx, dst, outdeg): neighbors numbered from 0 by id (then edge id)."""
    order = [F.col("dst")] + ([F.col("edge_id")] if "edge_id" in edges.columns else [])
    numbered = number_within(edges, ["src"], order, "_n", hot_rows, at_most)
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("outdeg"))
    joined = join_unique(numbered, degree, ["src"], hot_rows=hot_rows, at_most=at_most)
    return joined.select("src", (F.col("_n") - 1).alias("idx"), "dst", "outdeg")


def step_table(graph: Graph) -> DataFrame:
    """(src, idx, dst), neighbors numbered from 0 by id (then edge id), bucketed by (src, idx). They
    are numbered where ``graph.links`` holds them, so the edges move once."""
    if "steps" not in graph._prepared:
        links = graph.links("out")
        order = [F.col("to"), F.col("edge_id")]
        place = F.row_number().over(Window.partitionBy("at").orderBy(*order)).cast("long")
        numbered = links.cold.select("at", "to", "edge_id").withColumn("_n", place)
        if links.hot is not None:
            hot = links.hot.select("at", "to", "edge_id")
            numbered = numbered.unionByName(number_within(hot, ["at"], order, "_n", graph.hot_rows))
        table = numbered.select(F.col("at").alias("src"), (F.col("_n") - 1).alias("idx"), F.col("to").alias("dst"))
        graph._prepared["steps"] = cut_bucketed(table, ["src", "idx"], bucket_count(table.sparkSession, graph.edge_count()))
    return graph._prepared["steps"]


def out_degrees(graph: Graph) -> DataFrame:
    """(current, outdeg) of the vertices with out-edges, bucketed by ``current``."""
    if "out_degrees" not in graph._prepared:
        links = graph.links("out")
        degree = links.cold.groupBy("at").agg(F.count(F.lit(1)).alias("outdeg"))
        if links.hot is not None:
            degree = degree.unionByName(links.hot.groupBy("at").agg(F.count(F.lit(1)).alias("outdeg")))
        degree = degree.withColumnRenamed("at", "current")
        graph._prepared["out_degrees"] = cut_bucketed(degree, ["current"], bucket_count(degree.sparkSession, graph.edge_count()))
    return graph._prepared["out_degrees"]


def random_neighbor(walks: DataFrame, graph: Graph, step: int = 1, seed: int = 0, mode: str = "xxhash64") -> DataFrame:
    """One uniform pick per row of ``walks(source, walk, current, ...)``: column ``next``, -1 at
    a vertex without out-neighbors."""
    known = join_unique(walks, out_degrees(graph), ["current"], "left", graph.hot_rows)
    drawn = known.withColumn("idx", _pick(step, seed, mode))
    target = step_table(graph).select(F.col("src").alias("current"), "idx", F.col("dst").alias("next"))
    out = join_unique(drawn, target, ["current", "idx"], "left", graph.hot_rows)
    return out.withColumn("next", F.coalesce("next", F.lit(NO_NEIGHBOR))).drop("idx", "outdeg")


def _pick(step: int, seed: int, mode: str) -> Column:
    return F.pmod(draw(F.col("source"), F.col("walk"), F.lit(step), F.col("current"), seed, mode), F.col("outdeg"))


def _start(graph: Graph, samplings: int) -> DataFrame:
    """``samplings`` walks per vertex."""
    walk = F.explode(F.sequence(F.lit(1), F.lit(samplings))).alias("walk")
    return graph.vertex_ids().select(F.col("id").alias("source"), walk, F.col("id").alias("current"))


def _advance(walks: DataFrame, graph: Graph, step: int, seed: int, mode: str, at_most: int) -> DataFrame:
    """The walks at vertices with out-edges moved one hop: ``hop`` is the new vertex.
    There are never more walks than at the start, ``at_most``."""
    degree, keys = out_degrees(graph), ["current", "idx"]
    target = step_table(graph).select(F.col("src").alias("current"), "idx", F.col("dst").alias("hop"))

    def draws(known: DataFrame) -> DataFrame:
        return known.withColumn("idx", _pick(step, seed, mode)).drop("outdeg")

    crowded = hot_keys(walks, ["current"], graph.hot_rows, at_most)
    if crowded is None:
        return draws(walks.join(degree, "current")).join(target, keys).drop(*keys)
    calm, many = split_hot(walks, crowded)
    # only where many walks are can many draw the same edge; one row per hot vertex is broadcast
    few = degree.join(F.broadcast(crowded.table.select("current")), "current", "left_semi")
    many = draws(many.join(F.broadcast(few), "current"))
    moved = join_beside(many, target, keys, hot_keys(many, keys, graph.hot_rows, at_most))
    return draws(calm.join(degree, "current")).join(target, keys).unionByName(moved).drop(*keys)


def _hops(graph: Graph, samplings: int, steps: int, seed: int, mode: str) -> list[DataFrame]:
    """The log of all walks: table t holds (source, walk, step, current) of those that made
    t hops. Each hop is written once, and only these columns travel."""
    log = [cut(_start(graph, samplings).withColumn("step", F.lit(0)))]
    n = log[0].count()
    for step in range(1, steps + 1):
        moved = _advance(log[-1], graph, step, seed, mode, n)
        moved = moved.withColumn("step", F.lit(step)).withColumnRenamed("hop", "current")
        log.append(cut(moved.select(*log[0].columns)))
        if log[-1].isEmpty():
            break
    return log


def _paths(graph: Graph, samplings: int, steps: int, seed: int, mode: str, mark_sinks: bool) -> DataFrame:
    """Walks with their paths: the hops of a walk, at most ``steps``, meet in one grouping."""
    rows = union_rows(*_hops(graph, samplings, steps, seed, mode))
    hop = F.struct("step", "current")
    walked = rows.groupBy("source", "walk").agg(F.sort_array(F.collect_list(hop)).alias("hops"))
    last = F.element_at("hops", -1)
    path = F.transform(F.slice("hops", 2, F.size("hops")), lambda h: h["current"])
    if mark_sinks:
        # a walk that wanted to go on from a sink ends with the marker; only sinks stop walks early
        path = F.when(last["step"] < steps, F.array_append(path, F.lit(NO_NEIGHBOR).cast("long"))).otherwise(path)
    return walked.select("source", "walk", last["step"].alias("step"), last["current"].alias("current"), path.alias("path"))


def walk_segments(
    graph: Graph, samplings: int, steps: int, seed: int = 0, mode: str = "xxhash64", on_sink: str = "keep"
) -> DataFrame:
    """(source, walk, step, current, path): walks from every vertex; the path lists the visited
    vertices after the source. ``on_sink='keep'`` leaves a walk at the sink it reached,
    ``'mark'`` appends -1 to it."""
    return _paths(graph, samplings, steps, seed, mode, on_sink == "mark")


def full_walks(graph: Graph, samplings: int, steps: int, seed: int = 0, mode: str = "xxhash64", include_next: bool = False) -> DataFrame:
    """Walks whose path ends with -1 once a sink stops them. ``include_next`` draws the hop
    after the last round too, as the state between rounds holds it."""
    return _paths(graph, samplings, steps + (1 if include_next else 0), seed, mode, True)


def walk_ids(graph: Graph, samplings: int, steps: int, seed: int = 0, mode: str = "xxhash64") -> DataFrame:
    """(source, walk, step, current): only identity and position travel, no paths."""
    log = _hops(graph, samplings, steps, seed, mode)
    n = log[0].count()
    ended = [join_unique(t, out_degrees(graph), ["current"], "left_anti", graph.hot_rows, n) for t in log[:-1]]
    return union_rows(*ended, log[-1]).select("source", "walk", "step", "current")


def segments_by_source(
    walks: DataFrame, vertices: DataFrame | None = None, chunk: int = 10_000, hot_rows: int | None = None
) -> DataFrame:
    """(source, chunk, segments): every segment back at the vertex that started it. With
    ``vertices`` those without walks come too, with an empty list."""
    rows = walks.select("source", "walk", "path")
    lists = in_chunks(rows, ["source"], F.struct("walk", "path"), [F.col("walk")], "segments", chunk, hot_rows)
    if vertices is None:
        return lists
    everyone = vertices.select(F.col("id").alias("source"))
    kind = lists.schema["segments"].dataType
    return everyone.join(lists, "source", "left").select(
        "source", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("segments", F.array().cast(kind)).alias("segments")
    )


def walk_lengths(n: int, teleport: float = 0.15, seed: int = 0, spark=None) -> DataFrame:
    """(walk, length) of ``n`` walks, lengths geometric with mean 1 / teleport."""
    u = (F.xxhash64(F.lit(seed).cast("long"), F.col("id")).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / F.lit(float(1 << 52))
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("walk"), geometric_length(u, teleport).alias("length"))


def geometric_length(u: Column, teleport: float) -> Column:
    """Geometric length from a uniform number in (0, 1)."""
    return F.greatest(F.lit(1), F.ceil(F.log(F.lit(1.0) - u) / F.log(F.lit(1.0 - teleport))).cast("int"))


# fixed value: the walk lengths every hub starts with
HUB_WALK_LENGTHS = (2, 3, 5, 6, 9, 15, 20, 27, 30)


def hub_walks(
    graph: Graph, hubs: DataFrame, lengths=HUB_WALK_LENGTHS, max_steps: int | None = None, seed: int = 0, mode: str = "xxhash64"
) -> DataFrame:
    """(id, hub, n): arrivals per vertex and hub. A hub with value > 0 starts one walk per
    length and counts them as visits to itself; a walk of length L makes L arrivals unless it
    reaches a sink first."""
    steps = max(lengths) if max_steps is None else min(max_steps, max(lengths))
    known = graph.vertex_ids().withColumnRenamed("id", "seed")
    starts = hubs.filter(F.col("value") > 0).select("seed").distinct().join(known, "seed", "left_semi")
    state = cut(
        starts.select(
            F.col("seed").alias("source"),
            F.posexplode(F.lit([int(x) for x in lengths]).cast("array<int>")).alias("walk", "remaining"),
            F.col("seed").alias("current"),
        ).withColumn("walk", F.col("walk") + 1)
    )
    n, arrivals = state.count(), state.select("current", "source")
    for step in range(1, steps + 1):
        going = state.filter(F.col("remaining") > 0)
        moved = _advance(going, graph, step, seed, mode, n).withColumnRenamed("hop", "current")
        # the step tables stay: they are the arrivals, counted once at the end
        state = cut(moved.withColumn("remaining", F.col("remaining") - 1).select(*state.columns))
        if state.isEmpty():
            break
        arrivals = arrivals.unionByName(state.select("current", "source"))
    return arrivals.groupBy(F.col("current").alias("id"), F.col("source").alias("hub")).agg(F.count(F.lit(1)).alias("n"))
