from .partitioning import METHODS, label_blocks, partition_edges
from .reports import compare_partitionings, walk_traffic

__all__ = ["METHODS", "compare_partitionings", "label_blocks", "partition_edges", "walk_traffic"]
