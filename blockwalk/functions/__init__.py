from .mixing import affine, draw, mix, pair_mix
from .scores import (
    map_add,
    map_scale,
    map_without,
    rank_key,
    score_array,
    score_map,
    top_k,
)

__all__ = [
    "affine", "draw", "mix", "pair_mix",
    "map_add", "map_scale", "map_without", "rank_key", "score_array", "score_map", "top_k",
]
