"""Small helpers: nested dicts out of long frames, brute-force rules, random graphs."""

import random


def nested(rows, outer, inner, value, digits=6):
    out = {}
    for r in rows:
        v = r[value]
        out.setdefault(r[outer], {})[r[inner]] = round(v, digits) if isinstance(v, float) else v
    return out


def flat(rows, key, value, digits=6):
    return {r[key]: round(r[value], digits) if isinstance(r[value], float) else r[value] for r in rows}


def random_pairs(seed, vertices, edges, hub_share=0.0):
    """Random (src, dst) pairs; ``hub_share`` of them start at vertex 1."""
    rng = random.Random(seed)
    out = []
    for _ in range(edges):
        src = 1 if rng.random() < hub_share else rng.randint(1, vertices)
        out.append((src, rng.randint(1, vertices)))
    return out


def greedy_scan(profiles, room):
    """profiles: {edge_id: [(seed, key), ...] best first}; plain scan over all entries."""
    room = dict(room)
    block = {}
    entries = [(-key, e, i, seed) for e, p in profiles.items() for i, (seed, key) in enumerate(p)]
    # an edge's own entries keep their order; equal scores go to the smaller edge id
    for _, e, _, seed in sorted(entries, key=lambda x: (x[0], x[1], x[2])):
        if e not in block and room.get(seed, 0) > 0:
            block[e] = seed
            room[seed] -= 1
    return {e: block.get(e, -1) for e in profiles}
