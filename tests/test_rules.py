"""Distributed greedy rules against their plain sequential form on random graphs."""

import random

import pytest
from helpers import greedy_scan, random_pairs
from pyspark.sql import functions as F

from blockwalk import Graph, build_graph, from_edges
from blockwalk.operators import balance, blocks, metrics, ppr
from blockwalk.operators.seeds import spread_seeds, top_degree_seeds


def profile_table(spark, profiles):
    rows = [(e, e, e + 1000, [(s, float(k)) for s, k in p]) for e, p in profiles.items()]
    return spark.createDataFrame(
        rows, "edge_id long, src long, dst long, profile array<struct<seed:bigint,score:double>>"
    )


@pytest.mark.parametrize("case", range(4))
def test_capped_assign_is_the_scan(spark, case):
    rng = random.Random(case)
    seeds = list(range(1, 6))
    profiles = {}
    for e in range(1, 120):
        chosen = rng.sample(seeds, rng.randint(0, 4))
        # few distinct scores: ties everywhere; one seed attracts far more than its cap
        entries = [(s, rng.randint(1, 6) + (6 if s == 1 and rng.random() < 0.7 else 0)) for s in chosen]
        profiles[e] = sorted(entries, key=lambda x: (-x[1], x[0]))
    room = {s: rng.randint(0, 30) for s in seeds}
    seed_table = spark.createDataFrame([(s, 1.0) for s in seeds], "seed long, value double")
    got = balance.capped_assign(profile_table(spark, profiles), seed_table, room=spark.createDataFrame(list(room.items()), "seed long, room long"))
    assert {r["edge_id"]: r["block"] for r in got.collect()} == greedy_scan(profiles, room)


@pytest.mark.parametrize(("near", "hot_rows"), [(0, None), (5, None), (40, 50)])
def test_capped_assign_reads_what_was_refused(spark, monkeypatch, near, hot_rows):
    """Many seeds and edges, narrow lines: proposals above the second line are read again."""
    monkeypatch.setattr(balance, "_NEAR", near)
    rng = random.Random(near)
    seeds, profiles = list(range(1, 13)), {}
    for e in range(1, 2001):
        chosen = rng.sample(seeds, rng.randint(1, 6))
        profiles[e] = sorted(((s, rng.randint(1, 60) + 100 // s) for s in chosen), key=lambda x: (-x[1], x[0]))
    # seed 12 has no room and seed 11 is not offered at all
    room = {s: rng.choice((60, 120, 180)) for s in seeds[:-2]} | {12: 0}
    seed_table = spark.createDataFrame([(s, 1.0) for s in seeds], "seed long, value double")
    rounds = []
    got = balance.capped_assign(
        profile_table(spark, profiles), seed_table, room=spark.createDataFrame(list(room.items()), "seed long, room long"), hot_rows=hot_rows, progress=rounds
    )
    assert {r["edge_id"]: r["block"] for r in got.collect()} == greedy_scan(profiles, room)
    assert len(rounds) > 4 and rounds[0]["new"] > 1900
    if near == 40:
        assert sum(r["new"] + r["near"] + r["reread"] for r in rounds[5:]) < 0.5 * 2000 * (len(rounds) - 5)


def test_every_edge_has_one_block(spark):
    graph = from_edges(spark, random_pairs(3, 60, 300, 0.3))
    seeds = top_degree_seeds(graph.edges, 5).cache()
    profiles = blocks.edge_profiles(graph, blocks.propagate(graph, seeds, 3, 3), 3).cache()
    cap = balance.default_cap(300, 5)
    for assigned in (balance.capped_assign(profiles, seeds), balance.partial_reschedule(profiles, seeds)):
        filled = balance.fill_residual(assigned, seeds, cap).collect()
        assert sorted(r["edge_id"] for r in filled) == list(range(1, 301))
        load = {}
        for r in filled:
            load[r["block"]] = load.get(r["block"], 0) + 1
        assert -1 not in load and max(load.values()) <= cap


def test_kept_edges_stay(spark):
    profiles = {1: [(1, 9)], 2: [(1, 8), (2, 7)], 3: [(1, 7), (2, 6)], 4: [(2, 5)], 5: [(2, 4)], 6: []}
    seeds = spark.createDataFrame([(1, 1.0), (2, 1.0)], "seed long, value double")
    got = {r["edge_id"]: r["block"] for r in balance.partial_reschedule(profile_table(spark, profiles), seeds, 2, 0.5).collect()}
    # each seed keeps one; 2 takes seed 1's free place, 3 the one left at seed 2, 5 finds none
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: -1, 6: -1}


@pytest.mark.parametrize("case", range(2))
def test_spread_seeds_is_the_walk(spark, case):
    pairs = random_pairs(case + 20, 50, 90)
    near, degree = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    order = sorted(degree, key=lambda v: (-degree[v], -v))
    taken, marked = [], set()
    for v in order:
        if v not in marked:
            taken.append(v)
            marked |= near[v]
    graph = from_edges(spark, pairs)
    for n in (5, 1000):
        got = [r["seed"] for r in spread_seeds(graph.edges, n).orderBy("rank").collect()]
        assert got == taken[:n]
    few = [v for v in taken if v in order[:20]]
    got = [r["seed"] for r in spread_seeds(graph.edges, 1000, candidates=20).orderBy("rank").collect()]
    assert got == few


@pytest.mark.parametrize("case", range(3))
def test_water_fill_is_the_loop(spark, case):
    rng = random.Random(case)
    sizes = {p: rng.randint(0, 40) for p in range(rng.randint(1, 9))}
    residual = rng.randint(0, 120)
    table = spark.createDataFrame(list(sizes.items()), "part long, n_edges long")
    got = balance.water_fill(table, residual).collect()
    level = 0
    while sum(max(0, level + 1 - n) for n in sizes.values()) <= residual:
        level += 1
    want = {p: max(n, level) for p, n in sizes.items()}
    smallest = min(sizes, key=lambda p: (sizes[p], p))
    want[smallest] += residual - sum(want[p] - n for p, n in sizes.items())
    assert {r["part"]: r["n_edges"] + r["quota"] for r in got} == want


def merge_by_overlap(members, edges, parts, share):
    order = sorted(edges, key=lambda b: (-edges[b], b))
    opened = []
    for b in order:
        if len(opened) < parts and all(
            len(members[b] & members[o]) <= share * min(len(members[b]), len(members[o])) for o in opened
        ):
            opened.append(b)
    part = {b: p for p, b in enumerate(opened)}
    load = [edges[b] for b in opened]
    held = [set(members[b]) for b in opened]
    left = [b for b in order if b not in part]
    while left:
        p = min(range(parts), key=lambda q: (load[q], q))
        b = min(left, key=lambda x: (-len(members[x] & held[p]), -edges[x], x))
        part[b] = p
        load[p] += edges[b]
        held[p] |= members[b]
        left.remove(b)
    return part


@pytest.mark.parametrize("case", range(2))
def test_overlap_merge_is_the_sequence(spark, case):
    rng = random.Random(case)
    members = {b: set(rng.sample(range(60), rng.randint(5, 20))) for b in range(1, 15)}
    edges = {b: rng.randint(5, 60) for b in members}
    sizes = spark.createDataFrame(list(edges.items()), "block long, n_edges long")
    table = spark.createDataFrame([(b, v) for b, s in members.items() for v in s], "block long, id long")
    got = balance.merge_blocks_overlap(sizes, table, 3, 0.5)
    assert {r["block"]: r["part"] for r in got.collect()} == merge_by_overlap(members, edges, 3, 0.5)
    with pytest.raises(ValueError):
        balance.merge_blocks_overlap(sizes, table, 14, 0.0)


@pytest.mark.parametrize(("ahead", "parts", "seed"), [(16, 4, 1), (4096, 6, 2), (262144, 5, 3)])
def test_overlap_merge_decides_ahead(spark, monkeypatch, ahead, parts, seed):
    """Many blocks of few vertices: what is shown runs out, bounds are reached, ties are frequent."""
    monkeypatch.setattr(balance, "_AHEAD_ROWS", ahead)
    rng = random.Random(seed)
    members = {b: set(rng.sample(range(40 + 4 * b), rng.randint(1, 14))) for b in range(1, 81)}
    edges = {b: rng.randint(1, 9) * (5 if b < 5 else 1) for b in members}
    sizes = spark.createDataFrame(list(edges.items()), "block long, n_edges long")
    table = spark.createDataFrame([(b, v) for b, s in members.items() for v in s], "block long, id long")
    counts = []
    got = balance.merge_blocks_overlap(sizes, table, parts, 0.9, progress=counts)
    assert {r["block"]: r["part"] for r in got.collect()} == merge_by_overlap(members, edges, parts, 0.9)
    assert sum(counts) == 80 - parts and min(counts) > 0
    assert len(counts) < (80 - parts) / 2


def test_a_partition_that_lags_takes_many_blocks_per_count(spark):
    """One large block and 20 small ones: the partition of the small ones is always the smallest."""
    rng = random.Random(9)
    members = {1: set(range(1000))} | {b: set(rng.sample(range(900, 1300), 30)) for b in range(2, 22)}
    edges = {b: 5000 if b == 1 else 20 + b for b in members}
    sizes = spark.createDataFrame(list(edges.items()), "block long, n_edges long")
    table = spark.createDataFrame([(b, v) for b, s in members.items() for v in s], "block long, id long")
    counts = []
    got = balance.merge_blocks_overlap(sizes, table, 2, 1.0, progress=counts)
    assert {r["block"]: r["part"] for r in got.collect()} == merge_by_overlap(members, edges, 2, 1.0)
    assert len(counts) <= 4


@pytest.mark.parametrize("chunk", [2, 7, 256])
def test_overlaps_of_a_vertex_in_very_many_blocks(spark, chunk):
    rng = random.Random(chunk)
    sets = {b: {1} | {rng.randint(2, 30) for _ in range(rng.randint(0, 6))} for b in range(1, 90)}
    table = spark.createDataFrame([(b, v) for b, s in sets.items() for v in s], "block long, id long")
    got = {(r["a"], r["b"]): r["shared"] for r in balance.block_overlaps(table, chunk).collect()}
    assert got == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}


def test_cross_boundary_walks_are_met_from_outside(spark):
    rng = random.Random(5)
    edges = [(i, 1 if rng.random() < 0.3 else rng.randint(1, 40), rng.randint(1, 40), rng.randint(0, 6)) for i in range(300)]
    walks = [(rng.randint(1, 45), w, 1 if rng.random() < 0.4 else rng.randint(1, 45)) for w in range(400)]
    placed = spark.createDataFrame(edges, "edge_id long, src long, dst long, part int")
    walked = spark.createDataFrame(walks, "source long, walk int, current long")
    want = {}
    for part in range(7):
        ends = [v for _, a, b, p in edges if p == part for v in (a, b)]
        n = sum(ends.count(at) for source, _, at in walks if source not in ends)
        if n:
            want[part] = n
    for hot_rows in (None, 10):
        assert {r["part"]: r["walks"] for r in metrics.cross_boundary_walks(walked, placed, hot_rows=hot_rows).collect()} == want


@pytest.mark.parametrize("include_next", [False, True])
def test_paths_from_the_log_follow_the_draws(spark, include_next):
    """Paths against a plain walk with the same draws; a sink ends a walk that wanted to go on."""
    from blockwalk.operators import walks

    pairs = sorted(set(random_pairs(4, 30, 60)))
    graph = from_edges(spark, pairs)
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    bounded = lambda x: x % 2147483647
    got = {(r["source"], r["walk"]): r for r in walks.full_walks(graph, 2, 4, mode="affine", include_next=include_next).collect()}
    vertices = {v for p in pairs for v in p}
    assert got.keys() == {(v, w) for v in vertices for w in (1, 2)}
    for (source, walk), row in got.items():
        at, path, steps = source, [], 4 + include_next
        for step in range(1, steps + 1):
            if at not in near:
                path.append(-1)
                break
            pick = bounded(source) * 1000003 + walk * 7919 + step * 104729 + bounded(at) * 31 + 7
            at = near[at][pick % len(near[at])]
            path.append(at)
        assert (row["path"], row["current"], row["step"]) == (path, at, len([v for v in path if v != -1]))


def test_overlaps_count_shared_vertices(spark):
    sets = {1: {1, 2, 3, 4}, 2: {2, 3, 9}, 3: {3, 4, 9}, 4: {77}}
    table = spark.createDataFrame([(b, v) for b, s in sets.items() for v in s], "block long, id long")
    got = {(r["a"], r["b"]): r["shared"] for r in balance.block_overlaps(table).collect()}
    assert got == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}


def test_multigraph_counts_every_edge(spark):
    graph = from_edges(spark, [(1, 2), (1, 2), (1, 3), (2, 3), (2, 2)])
    seeds = spark.createDataFrame([(1, 90.0)], "seed long, value double")
    got = {r["id"]: r["score"] for r in blocks.propagate(graph, seeds, 1, 5).collect()}
    assert got == {1: 90.0, 2: 60.0, 3: 30.0}
    # a self-loop counts its end twice
    profile = {r["edge_id"]: r["profile"][0]["score"] for r in blocks.edge_profiles(graph, blocks.propagate(graph, seeds, 1, 5), 5).collect()}
    assert profile[4] == 120.0 or profile[3] == 120.0


def test_given_vertices_join_the_graph(spark):
    edges = spark.createDataFrame([(1, 1, 2)], "edge_id long, src long, dst long")
    given = spark.createDataFrame([(2, "x"), (9, "y")], "id long, name string")
    graph = build_graph(edges, given, {"name": "none"})
    assert {r["id"]: r["name"] for r in graph.vertices.collect()} == {1: "none", 2: "x", 9: "y"}
    ids = build_graph(edges).vertices.agg(F.count("id")).first()[0]
    assert ids == 2


def test_scores_that_differ_in_the_eighth_digit(spark):
    from blockwalk.functions import top_k

    table = spark.createDataFrame([(1, 3, 200000.001), (1, 9, 200000.004)], "id long, seed long, score double")
    assert [r["seed"] for r in top_k(table, 1, ["id"]).collect()] == [9]
    profile = blocks.edge_profiles(from_edges(spark, [(1, 2)]), table, 2).first()["profile"]
    assert [e["seed"] for e in profile] == [9, 3]


def test_sums_do_not_depend_on_the_order_of_messages(spark):
    graph = from_edges(spark, [(s, 9) for s in range(1, 9)] + [(s, 20 + s) for s in range(1, 9)] + [(s, 40 + s) for s in range(1, 9)])
    seeds = spark.createDataFrame([(s, 1.0 + s / 7) for s in range(1, 9)], "seed long, value double")
    one = blocks.propagate(graph, seeds, 2, 8).orderBy("id", "seed").collect()
    two = blocks.propagate(Graph(graph.vertices, graph.edges.repartition(5, "dst")), seeds.repartition(3), 2, 8).orderBy("id", "seed").collect()
    assert one == two


def test_empty_tables_of_sizes(spark):
    sizes = spark.createDataFrame([], "part long, n_edges long")
    assert balance.water_fill(sizes, 5).collect() == []
    assert balance.balance_stats(sizes).collect() == []


def test_single_source_rows_equal_those_of_the_whole_table(spark):
    graph = from_edges(spark, random_pairs(3, 30, 150, hub_share=0.2))
    whole = ppr.inverse_p_distance(graph, 2)
    for source in (1, 7):
        some = ppr.inverse_p_distance_from(graph, spark.createDataFrame([(source,)], "id long"), 2)
        want = {(r["id"], r["target"]): r["score"] for r in whole.filter(F.col("id") == source).collect()}
        got = {(r["id"], r["target"]): r["score"] for r in some.collect()}
        assert got == pytest.approx(want)


def test_doubling_towards_targets(spark):
    graph = from_edges(spark, random_pairs(4, 30, 150))
    targets = spark.createDataFrame([(2,), (5,)], "id long")
    for rounds in (0, 1, 2):
        whole = ppr.inverse_p_distance_doubling(graph, rounds).join(targets.withColumnRenamed("id", "target"), "target", "left_semi")
        some = ppr.inverse_p_distance_doubling(graph, rounds, targets=targets)
        key = lambda df: {(r["id"], r["target"]): r["score"] for r in df.collect()}
        assert key(some) == pytest.approx(key(whole))


def test_seed_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("9\t2.5\n4\n\n7\t1\n")
    from blockwalk.sources import read_seeds

    got = [(r["seed"], r["value"]) for r in read_seeds(spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(9, 2.5), (4, 100000.0), (7, 1.0)]


def test_running_sums_over_partitions(spark):
    from blockwalk.skew import running_sum

    table = spark.createDataFrame([(i, i % 5) for i in range(40)], "id long, n long").repartition(6)
    got = {r["id"]: r["before"] for r in running_sum(table, [F.col("id")], "n", "before").collect()}
    assert got == {i: sum(k % 5 for k in range(i)) for i in range(40)}
    assert running_sum(table.limit(0), [F.col("id")], "n", "before").collect() == []


def test_residual_follows_the_order_of_the_seed_file(spark):
    edges = spark.createDataFrame([(i, i, i + 100, -1) for i in range(1, 6)], "edge_id long, src long, dst long, block long")
    seeds = spark.createDataFrame([(3, 2), (8, 0), (5, 1)], "seed long, rank long")
    got = {r["edge_id"]: r["block"] for r in balance.fill_residual(edges, seeds, 2).collect()}
    assert got == {1: 8, 2: 8, 3: 5, 4: 5, 5: 3}


def test_the_merge_limit_is_the_callers(spark):
    sizes = spark.createDataFrame([(b, 10) for b in range(5)], "block long, n_edges long")
    assert balance.merge_blocks_lpt(sizes, 2, max_blocks=5).count() == 5
    with pytest.raises(ValueError):
        balance.merge_blocks_lpt(sizes, 2, max_blocks=4)
