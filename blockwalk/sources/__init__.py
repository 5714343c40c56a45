from .edge_lists import (
    attr_edges_from_lines,
    edges_from_lines,
    labeled_edges_from_lines,
    read_attr_edges,
    read_edges,
    read_labeled_edges,
    read_topic_edges,
    topic_edges_from_lines,
)
from .partitions import partition_contents, read_partitioned_edges, write_partitioned_edges
from .results import (
    block_representatives_from_lines,
    block_representatives_to_lines,
    read_block_representatives,
    read_seed_distances,
    sample_vertices,
    save_vertices,
    seed_distances_from_lines,
    seed_distances_to_lines,
    write_block_representatives,
    write_seed_distances,
)
from .seed_files import read_seeds, seeds_from_lines, write_seeds

__all__ = [
    "attr_edges_from_lines", "edges_from_lines", "labeled_edges_from_lines", "read_attr_edges", "read_edges",
    "read_labeled_edges", "read_topic_edges", "topic_edges_from_lines",
    "partition_contents", "read_partitioned_edges", "write_partitioned_edges",
    "block_representatives_from_lines", "block_representatives_to_lines", "read_block_representatives",
    "read_seed_distances", "sample_vertices", "save_vertices", "seed_distances_from_lines",
    "seed_distances_to_lines", "write_block_representatives", "write_seed_distances",
    "read_seeds", "seeds_from_lines", "write_seeds",
]
