"""Block edge partitioning, random walks and personalized PageRank as Spark DataFrame jobs."""

from .graph import Graph, Links, build_graph, from_edges, message_step, with_edge_ids
from .runtime import cut, iterate, release

__all__ = ["Graph", "Links", "build_graph", "cut", "from_edges", "iterate", "message_step", "release", "with_edge_ids"]
