"""Graphs as edge and vertex tables, and the one message step all loops share."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import bucket_count, cut, cut_bucketed
from .skew import HotKeys, every_slot, hot_keys, join_beside, join_known, number_all, split_hot, with_slot


@dataclass
class Graph:
    """``vertices(id, ...)`` and ``edges(edge_id, src, dst, ...)``; duplicates are kept."""

    vertices: DataFrame
    edges: DataFrame
    hot_rows: int | None = None
    _prepared: dict = field(default_factory=dict, repr=False)

    def join_end(self, edges: DataFrame, end: str, values: DataFrame, how: str = "inner", rows: int | None = None) -> DataFrame:
        """``edges`` (this graph's, any columns) joined to one row per vertex on ``src`` or ``dst``."""
        key = ("hot", end)
        if key not in self._prepared:
            self._prepared[key] = hot_keys(self.edges, [end], self.hot_rows, self.edge_count())
        return join_beside(edges, values, [end], self._prepared[key], how, rows)

    def vertex_ids(self) -> DataFrame:
        """The ids alone, materialised once."""
        if "ids" not in self._prepared:
            self._prepared["ids"] = cut(self.vertices.select("id"))
        return self._prepared["ids"]

    def edge_count(self) -> int:
        if "edge_count" not in self._prepared:
            self._prepared["edge_count"] = self.edges.count()
        return self._prepared["edge_count"]

    def weighted_edges(self) -> DataFrame:
        """Edges with the out-degree of their source: the tables laid out by ``src``, not written again."""
        links = self.links("out")
        rows = links.cold if links.hot is None else links.cold.unionByName(links.hot.drop("slot"))
        return rows.select(F.col("at").alias("src"), "edge_id", F.col("to").alias("dst"), "out_deg")

    def links(self, direction: str) -> Links:
        """Edge table laid out for sending along (``out``), against (``in``) or both ways."""
        if direction not in self._prepared:
            self._prepared[direction] = _lay_out(self, direction)
        return self._prepared[direction]


@dataclass
class Links:
    """Edges keyed by the sending end ``at``; ``to`` receives. Keys with too many edges for a
    task sit in ``hot``, spread over slots; the rest is bucketed by ``at``."""

    cold: DataFrame
    hot: DataFrame | None
    hot_ids: HotKeys | None
    hot_rows: int | None = None

    def join(self, state: DataFrame, many: bool = False) -> DataFrame:
        """Every (state row, edge leaving its ``id``) pair: columns of both.

        ``many`` says that ids may own any number of state rows (score tables): hot ones are
        then split over slots too, and their edges copied to each.
        """
        keyed = state.withColumnRenamed("id", "at")
        hot = hot_keys(keyed, ["at"], self.hot_rows) if many else None
        if hot is None:
            return self._pairs(keyed)
        everything = self.cold if self.hot is None else self.cold.unionByName(self.hot.drop("slot"))
        calm, crowded = split_hot(keyed, hot)
        spread = join_known(crowded, split_hot(everything, hot)[1], ["at"], hot, self.hot_ids)
        pairs = self._pairs(calm)
        return pairs.unionByName(spread.select(*pairs.columns))

    def with_sender(self, values: DataFrame) -> DataFrame:
        """Every edge with the columns of ``values`` (one row per ``id``) of its sending end, null
        where there is none. The bucketed edges do not move."""
        keyed = values.withColumnRenamed("id", "at")
        out = self.cold.join(keyed, "at", "left")
        if self.hot is None:
            return out
        few = keyed.join(F.broadcast(self.hot_ids.table.select("at")), "at", "left_semi")
        return out.unionByName(self.hot.drop("slot").join(F.broadcast(few), "at", "left"))

    def _pairs(self, keyed: DataFrame) -> DataFrame:
        pairs = keyed.join(self.cold, "at")
        if self.hot is None:
            return pairs
        spread = every_slot(keyed, self.hot_ids).join(self.hot, ["at", "slot"]).drop("slot")
        return pairs.unionByName(spread)


def _lay_out(graph: Graph, direction: str) -> Links:
    if direction == "out":
        return _lay_out_by_source(graph)
    edges = graph.weighted_edges()
    ends = {"in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    keyed = None
    for at, to in ends:
        part = edges.select(F.col(at).alias("at"), F.col(to).alias("to"), "out_deg", "edge_id")
        keyed = part if keyed is None else keyed.unionByName(part)
    rows = len(ends) * graph.edge_count()
    hot = hot_keys(keyed, ["at"], graph.hot_rows, rows)
    cold_rows = keyed if hot is None else split_hot(keyed, hot)[0]
    cold = cut_bucketed(cold_rows, ["at"], bucket_count(edges.sparkSession, rows))
    spread = None if hot is None else cut(with_slot(keyed, hot))
    return Links(cold, spread, hot, graph.hot_rows)


def _lay_out_by_source(graph: Graph) -> Links:
    """Edges move once: the degree is counted where they are dealt by their source."""
    rows = graph.edge_count()
    keyed = graph.edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "edge_id")
    hot = hot_keys(keyed, ["at"], graph.hot_rows, rows)
    columns = ["at", "to", "out_deg", "edge_id"]
    cold_rows, crowded = (keyed, None) if hot is None else split_hot(keyed, hot)
    degree = F.count(F.lit(1)).over(Window.partitionBy("at"))
    cold = cut_bucketed(
        cold_rows, ["at"], bucket_count(keyed.sparkSession, rows), lambda dealt: dealt.withColumn("out_deg", degree).select(*columns)
    )
    if hot is None:
        return Links(cold, None, None, graph.hot_rows)
    few = crowded.groupBy("at").agg(F.count(F.lit(1)).alias("out_deg"))  # a row per hot key
    crowded = crowded.join(F.broadcast(few), "at").select(*columns)
    return Links(cold, cut(with_slot(crowded, hot)), hot, graph.hot_rows)


def with_edge_ids(edges: DataFrame, start: int = 1, distinct: bool = False) -> DataFrame:
    """Give edges ids in (src, dst) order; rankings break score ties by this id. ``distinct``
    says that no (src, dst) pair repeats, which saves a pass."""
    return number_all(edges, [F.col("src"), F.col("dst")], "edge_id", start, total=distinct)


def build_graph(
    edges: DataFrame, vertices: DataFrame | None = None, default: dict | None = None, hot_rows: int | None = None
) -> Graph:
    """Vertex set = edge endpoints and the given vertices; missing attributes get ``default``."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    if vertices is not None:
        ids = ids.union(vertices.select("id"))
    ids = ids.distinct()
    if vertices is not None:
        ids = ids.join(vertices, "id", "left")
    for name, value in (default or {}).items():
        ids = ids.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in ids.columns else F.lit(value))
    return Graph(ids, edges, hot_rows)


def from_edges(spark, rows, default: dict | None = None) -> Graph:
    """In-memory ``(src, dst)`` pairs to a graph; edge ids follow (src, dst) order."""
    ordered = [(i + 1, int(s), int(d)) for i, (s, d) in enumerate(sorted(rows))]
    return build_graph(spark.createDataFrame(ordered, "edge_id long, src long, dst long"), default=default)


def message_step(
    links: Links,
    state: DataFrame,
    send: dict[str, Column],
    merge: dict[str, Column],
    by: tuple[str, ...] = (),
    active: Column | None = None,
    many: bool = False,
) -> DataFrame:
    """One round of send-along-edge and merge. ``many``: ``state`` may have any number of rows
    per vertex.

    ``active`` picks the sending rows of ``state``; ``send`` builds the message columns from
    state and edge columns; ``merge`` aggregates them per receiver (and ``by``). All three are
    column expressions, so Catalyst prunes, pushes down and combines map-side.
    """
    senders = state if active is None else state.filter(active)
    sent = links.join(senders, many).select(F.col("to").alias("id"), *[c.alias(n) for n, c in send.items()])
    return sent.groupBy("id", *by).agg(*[c.alias(n) for n, c in merge.items()])
