"""PageRank, connected components, triangle counts and landmark distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, message_step
from ..runtime import cut, iterate, release
from ..skew import join_spread, join_unique


def pagerank(graph: Graph, iterations: int, c: float = 0.15, cut_every: int = 3) -> DataFrame:
    """(id, rank): ``c + (1 - c) * sum`` of in-neighbor rank over out-degree, starting at c;
    not normalised."""
    links = graph.links("out")
    vertices = graph.vertex_ids()

    def step(state, _):
        sums = message_step(links, state, {"m": F.col("rank") / F.col("out_deg")}, {"m": F.sum("m")})
        return vertices.join(sums, "id", "left").select("id", (F.lit(c) + (1 - c) * F.coalesce("m", F.lit(0.0))).alias("rank"))

    return iterate(vertices.withColumn("rank", F.lit(c)), step, iterations, cut_every=cut_every)


def static_pagerank(graph: Graph, iterations: int, reset: float = 0.15) -> DataFrame:
    return pagerank(graph, iterations, reset)


def dynamic_pagerank(graph: Graph, tol: float, reset: float = 0.15, max_rounds: int | None = None) -> DataFrame:
    """(id, rank): a vertex passes on only its last change, and only while that exceeds tol."""
    links = graph.links("out")
    state = cut(graph.vertex_ids().select("id", F.lit(reset).alias("rank"), F.lit(reset).alias("delta")))

    def step(state, _):
        sums = message_step(
            links, state.select("id", "delta"), {"m": F.col("delta") / F.col("out_deg")}, {"m": F.sum("m")},
            active=F.col("delta") > tol,
        )
        change = (1 - reset) * F.coalesce("m", F.lit(0.0))
        return state.join(sums, "id", "left").select("id", (F.col("rank") + change).alias("rank"), change.alias("delta"))

    done = lambda s: s.filter(F.col("delta") > tol).isEmpty()
    return iterate(state, step, max_rounds, done).select("id", "rank")


def connected_components(graph: Graph, hot_rows: int | None = None) -> DataFrame:
    """(id, component): the smallest vertex id reachable ignoring direction.

    Alternating large-star and small-star contractions: the number of rounds grows with the
    logarithm of the graph, not with its longest chain. Minima are aggregated map-side and
    joined back with ``join_unique``, so the growing stars do not gather in one task.
    """
    hot_rows = graph.hot_rows if hot_rows is None else hot_rows
    ends = graph.edges.filter(F.col("src") != F.col("dst"))
    links = cut(ends.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark, n = None, links.count()
    while True:
        # a star operation never adds links
        large = cut(_large_star(links, hot_rows, n))
        small = cut(_small_star(large, hot_rows, n))
        now = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        release(links)
        release(large)
        links = small
        if mark == now:
            break
        mark, n = now, now["n"]
    found = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return graph.vertex_ids().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _large_star(links: DataFrame, hot_rows: int | None, n: int) -> DataFrame:
    """Every larger neighbor of a vertex is linked to the smallest vertex of its neighborhood."""
    both = links.select("u", "v").union(links.select("v", "u"))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # links(u > v): for center v the larger neighbor is u
    turned = links.select(F.col("v").alias("u"), F.col("u").alias("far"))
    out = join_unique(turned, lowest, ["u"], hot_rows=hot_rows, at_most=n)
    return out.select(F.col("far").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()


def _small_star(links: DataFrame, hot_rows: int | None, n: int) -> DataFrame:
    """A vertex and its smaller neighbors are linked to the smallest of them."""
    lowest = links.groupBy("u").agg(F.min("v").alias("m"))
    out = join_unique(links, lowest, ["u"], hot_rows=hot_rows, at_most=n)
    pairs = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
    return pairs.filter(F.col("u") != F.col("v")).distinct()


def triangle_count(graph: Graph, hot_rows: int | None = None) -> DataFrame:
    """(id, triangles) of every vertex; direction, duplicates and loops are ignored.

    Edges point from lower to higher (degree, id), which bounds the out-degree by the square
    root of the edges, so no vertex pairs up all neighbors of a hub.
    """
    hot_rows = graph.hot_rows if hot_rows is None else hot_rows
    ends = graph.edges.filter(F.col("src") != F.col("dst"))
    plain = cut(ends.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    degree = plain.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    degree = cut(degree)
    side_a = degree.select(F.col("id").alias("a"), F.col("d").alias("d_a"))
    side_b = degree.select(F.col("id").alias("b"), F.col("d").alias("d_b"))
    n = plain.count()
    known = join_unique(plain, side_a, ["a"], hot_rows=hot_rows, at_most=n)
    known = join_unique(known, side_b, ["b"], hot_rows=hot_rows, at_most=n)
    a_first = (F.col("d_a") < F.col("d_b")) | ((F.col("d_a") == F.col("d_b")) & (F.col("a") < F.col("b")))
    up = cut(
        known.select(
            F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("low"),
            F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("high"),
            F.greatest("d_a", "d_b").alias("d_high"),
        )
    )
    second = up.select("low", F.col("high").alias("third"), F.col("d_high").alias("d_third"))
    ascending = (F.col("d_high") < F.col("d_third")) | (
        (F.col("d_high") == F.col("d_third")) & (F.col("high") < F.col("third"))
    )
    wedges = join_spread(up, second, ["low"], hot_rows, n).filter(ascending)
    closing = up.select(F.col("low").alias("high"), F.col("high").alias("third"))
    triangles = wedges.select("low", "high", "third").join(closing, ["high", "third"], "left_semi")
    counts = triangles.select(F.explode(F.array("low", "high", "third")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return graph.vertex_ids().join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


def pick_landmarks(candidates: DataFrame, n: int) -> DataFrame:
    """The first ``n`` candidates by ``rank`` (or id); an error if there are fewer."""
    order = "rank" if "rank" in candidates.columns else "id"
    chosen = candidates.orderBy(order).limit(n)
    if chosen.count() < n:
        raise ValueError(f"fewer than {n} landmark candidates")
    return chosen.select("id")


def shortest_paths(graph: Graph, landmarks: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, landmark, hops) along out-edges, reachable pairs only."""
    links = graph.links("in")
    start = landmarks.select("id").distinct().join(graph.vertex_ids(), "id", "left_semi")
    state = cut(start.select("id", F.col("id").alias("landmark"), F.lit(0).alias("hops"), F.lit(True).alias("fresh")))

    def step(state, _):
        found = message_step(
            links, state, {"landmark": F.col("landmark"), "hops": F.col("hops") + 1}, {"hops": F.min("hops")},
            by=("landmark",), active=F.col("fresh"), many=True,
        )
        known = state.select("id", "landmark", F.col("hops").alias("old"), F.lit(None).cast("int").alias("new"))
        offered = found.select("id", "landmark", F.lit(None).cast("int").alias("old"), F.col("hops").alias("new"))
        best = known.unionByName(offered).groupBy("id", "landmark").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        return best.select(
            "id", "landmark", F.least("old", "new").alias("hops"),
            (F.col("old").isNull() | F.coalesce(F.col("new") < F.col("old"), F.lit(False))).alias("fresh"),
        )

    done = lambda s: s.filter("fresh").isEmpty()
    return iterate(state, step, max_rounds, done).select("id", "landmark", "hops")
