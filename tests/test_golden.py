"""Worked results on the micro graph."""

import pytest
from helpers import flat, nested
from pyspark.sql import functions as F

from blockwalk.operators import algorithms, balance, blocks, metrics, ppr, seeds, topics, walks
from blockwalk.graph import Graph


@pytest.fixture(scope="module")
def two_seeds(spark):
    return spark.createDataFrame([(1, 100000.0), (4, 100000.0)], "seed long, value double")


@pytest.fixture(scope="module")
def scores(micro, two_seeds):
    return blocks.propagate(micro, two_seeds, 3, 2)


@pytest.fixture(scope="module")
def profiles(micro, scores):
    return blocks.edge_profiles(micro, scores, 2).cache()


def pairs(df, value):
    return {(r["src"], r["dst"]): r[value] for r in df.collect()}


def test_propagate_rounds(micro, two_seeds, scores):
    one = nested(blocks.propagate(micro, two_seeds, 1, 2).collect(), "id", "seed", "score")
    assert one == {1: {1: 100000}, 2: {1: 50000}, 3: {1: 50000, 4: 50000}, 4: {4: 100000}, 5: {4: 50000}}
    two = nested(blocks.propagate(micro, two_seeds, 2, 2).collect(), "id", "seed", "score")
    assert two == {1: {1: 150000, 4: 50000}, 2: {1: 50000}, 3: {1: 100000, 4: 50000}, 4: {4: 100000}, 5: {4: 50000}}
    three = nested(scores.collect(), "id", "seed", "score")
    assert three == {
        1: {1: 200000, 4: 50000}, 2: {1: 75000, 4: 25000}, 3: {1: 125000, 4: 75000}, 4: {4: 100000}, 5: {4: 50000}
    }


def test_coverage(micro, scores):
    assert flat(blocks.coverage(micro, scores).collect(), "kind", "n") == {"vertices": 2, "edges": 1}


def test_profiles_and_blocks(profiles):
    got = {k: [(e["seed"], e["score"]) for e in v] for k, v in pairs(profiles, "profile").items()}
    assert got[(1, 2)] == [(1, 275000), (4, 75000)]
    assert got[(4, 3)] == [(4, 175000), (1, 125000)]
    assert got[(4, 5)] == [(4, 150000)]
    assert got[(6, 7)] == []
    labels = blocks.assign_blocks(profiles)
    assert pairs(labels, "block") == {(1, 2): 1, (1, 3): 1, (2, 3): 1, (3, 1): 1, (4, 3): 4, (4, 5): 4, (6, 7): -1}
    assert flat(blocks.block_sizes(labels).collect(), "block", "n_edges") == {1: 4, 4: 2}
    reps = {r["seed"]: (r["src"], r["dst"]) for r in blocks.block_representatives(labels).collect()}
    assert reps == {1: (1, 2), 4: (4, 3), -1: (6, 7)}


@pytest.mark.parametrize("cap, expected", [
    (4, {(1, 2): 1, (1, 3): 1, (2, 3): 1, (3, 1): 1, (4, 3): 4, (4, 5): 4, (6, 7): -1}),
    (2, {(1, 2): -1, (1, 3): 1, (2, 3): -1, (3, 1): 1, (4, 3): 4, (4, 5): 4, (6, 7): -1}),
])
def test_capped(profiles, two_seeds, cap, expected):
    assert pairs(balance.capped_assign(profiles, two_seeds, cap), "block") == expected


def test_residual(profiles, two_seeds):
    capped = balance.capped_assign(profiles, two_seeds)
    filled = pairs(balance.fill_residual(capped, two_seeds, 4), "block")
    assert filled[(6, 7)] == 4
    assert sorted(filled.values()) == [1, 1, 1, 1, 4, 4, 4]


def test_merge_and_fill(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([9, 7, 6, 5, 4, 3])], "block long, n_edges long")
    merge = balance.merge_blocks_lpt(sizes, 3)
    merged = balance.part_sizes(sizes, merge)
    assert sorted(r["n_edges"] for r in merged.collect()) == [11, 11, 12]
    filled = balance.water_fill(merged, 5).withColumn("n_edges", F.col("n_edges") + F.col("quota"))
    assert [r["n_edges"] for r in filled.collect()] == [13, 13, 13]
    stats = balance.balance_stats(filled).first()
    assert (stats["average"], stats["sd"]) == (13, 0.0)
    with pytest.raises(ValueError):
        balance.merge_blocks_lpt(sizes, 7)


@pytest.fixture(scope="module")
def halves(micro):
    return micro.edges.withColumn("part", F.when(F.col("src") < 4, 0).otherwise(1))


def test_replication(halves):
    row = metrics.replication_factor(halves).first()
    assert (row["replicas"], row["vertices"]) == (8, 7)
    assert flat(metrics.vertex_replicas(halves).collect(), "id", "replicas")[3] == 2


def test_pagerank(micro):
    got = flat(algorithms.pagerank(micro, 3).collect(), "id", "rank")
    assert got == {1: 0.586369, 2: 0.360056, 3: 0.651553, 4: 0.15, 5: 0.21375, 6: 0.15, 7: 0.2775}
    converged = flat(algorithms.dynamic_pagerank(micro, 1e-12).collect(), "id", "rank")
    assert converged == flat(algorithms.pagerank(micro, 200, cut_every=20).collect(), "id", "rank")


DISTANCE = {
    1: {1: 0.012937, 2: 0.075844, 3: 0.087094}, 2: {1: 0.0225, 2: 0.001688, 3: 0.151688},
    3: {1: 0.151688, 2: 0.01125, 3: 0.012937}, 4: {1: 0.01125, 2: 0.000844, 3: 0.075844, 5: 0.075}, 6: {7: 0.15},
}


def close(got, want):
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items()}
    for k, row in want.items():
        assert got[k] == pytest.approx(row, abs=2e-6)


def test_inverse_p_distance(micro):
    table = ppr.inverse_p_distance(micro, 2)
    close(nested(table.collect(), "id", "target", "score", 9), DISTANCE)
    close(nested(ppr.ppr_delta(micro, 2, delta=0.0).collect(), "id", "target", "score", 9), DISTANCE)
    elements = ppr.message_elements(micro, 2, delta=0.0).agg(F.sum("elements")).first()[0]
    assert elements == 15
    assert flat(ppr.scores_of(table, 6).collect(), "target", "score") == {7: 0.15}
    only = ppr.inverse_p_distance(micro, 2, targets=micro.vertices.filter("id = 3"))
    close(nested(only.collect(), "id", "target", "score", 9), {k: {3: v[3]} for k, v in DISTANCE.items() if 3 in v})


def test_delta(micro):
    got = nested(ppr.ppr_delta(micro, 2, delta=0.1).collect(), "id", "target", "score", 9)
    close(got, {
        1: {1: 0.01125, 2: 0.075, 3: 0.08625}, 2: {1: 0.0225, 3: 0.15}, 3: {1: 0.15},
        4: {1: 0.01125, 3: 0.075, 5: 0.075}, 6: {7: 0.15},
    })
    assert ppr.message_elements(micro, 2, delta=0.1).agg(F.sum("elements")).first()[0] == 4


def test_doubling(micro):
    exact = nested(ppr.inverse_p_distance_doubling(micro, 2).collect(), "id", "target", "score", 9)
    same = nested(ppr.inverse_p_distance(micro, 3).collect(), "id", "target", "score", 9)
    close(exact, same)


@pytest.mark.parametrize("rule, expected", [
    ("reference", {1: {1: 0.51125, 4: 0.36125}, 2: {1: 0.425}, 3: {1: 0.425, 4: 0.425}, 4: {4: 1}, 5: {4: 0.425}}),
    ("sum", {1: {1: 1.36125, 4: 0.36125}, 2: {1: 0.425}, 3: {1: 0.78625, 4: 0.425}, 4: {4: 1}, 5: {4: 0.425}}),
])
def test_hub_ppr(spark, micro, rule, expected):
    hubs = spark.createDataFrame([(1, 1.0), (4, 1.0)], "seed long, value double")
    assert nested(ppr.hub_ppr(micro, hubs, 2, rule=rule).collect(), "id", "seed", "score") == expected


def test_structure(spark, micro):
    marks = spark.createDataFrame([(1,), (7,)], "id long")
    got = nested(algorithms.shortest_paths(micro, marks).collect(), "landmark", "id", "hops")
    assert got == {1: {1: 0, 2: 2, 3: 1, 4: 2}, 7: {6: 1, 7: 0}}
    components = flat(algorithms.connected_components(micro).collect(), "id", "component")
    assert components == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6}
    triangles = flat(algorithms.triangle_count(micro).collect(), "id", "triangles")
    assert triangles == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}
    with pytest.raises(ValueError):
        algorithms.pick_landmarks(marks, 3)


def test_seeds(micro):
    assert [r["seed"] for r in seeds.top_degree_seeds(micro.edges, 3).collect()] == [3, 1, 4]
    spread = seeds.spread_seeds(micro.edges, 3).orderBy("rank")
    assert [r["seed"] for r in spread.collect()] == [3, 7, 5]


PATHS = {
    (1, 1): [3, 1, 3], (1, 2): [2, 3, 1], (2, 1): [3, 1, 2], (2, 2): [3, 1, 3], (3, 1): [1, 2, 3], (3, 2): [1, 3, 1],
    (4, 1): [5], (4, 2): [3, 1, 3], (6, 1): [7], (6, 2): [7], (5, 1): [], (5, 2): [], (7, 1): [], (7, 2): [],
}


def test_walks(micro, halves):
    got = walks.walk_segments(micro, 2, 3, mode="affine").cache()
    assert {(r["source"], r["walk"]): r["path"] for r in got.collect()} == PATHS
    visits = metrics.visit_counts(got)
    assert flat(visits.collect(), "id", "visits") == {1: 8, 2: 3, 3: 10, 5: 1, 7: 2}
    assert metrics.total_messages(visits, metrics.vertex_replicas(halves)).first()["messages"] == 34
    marked = walks.full_walks(micro, 2, 3, mode="affine")
    assert {(r["source"], r["walk"]): r["path"] for r in marked.collect()} == {
        k: p + [-1] if len(p) < 3 else p for k, p in PATHS.items()
    }
    ids = {(r["source"], r["walk"]): r["current"] for r in walks.walk_ids(micro, 2, 3, mode="affine").collect()}
    assert ids == {k: (p or [k[0]])[-1] for k, p in PATHS.items()}


def test_walk_lengths(spark, micro):
    lengths = walks.walk_lengths(4000, 0.15, spark=spark)
    rows = [r["length"] for r in lengths.collect()]
    assert min(rows) == 1 and sum(rows) / len(rows) == pytest.approx(1 / 0.15, rel=0.05)
    hubs = spark.createDataFrame([(1, 1.0), (5, 1.0), (2, 0.0)], "seed long, value double")
    got = walks.hub_walks(micro, hubs, rows[:6]).collect()
    # hub 1 never meets a sink: its own start visits plus every hop; hub 5 is one
    assert sum(r["n"] for r in got if r["hub"] == 1) == 6 + sum(rows[:6])
    assert [(r["id"], r["n"]) for r in got if r["hub"] == 5] == [(5, 6)]
    assert {r["hub"] for r in got} == {1, 5}


@pytest.fixture(scope="module")
def topical(spark, micro):
    labels = {(1, 2): ["a", "b"], (1, 3): ["a"], (2, 3): ["a", "b"], (3, 1): ["b"], (4, 3): ["a"], (4, 5): ["b"], (6, 7): ["a"]}
    rows = [(s, d, t) for (s, d), t in labels.items()]
    edges = micro.edges.join(spark.createDataFrame(rows, "src long, dst long, topics array<string>"), ["src", "dst"])
    return Graph(micro.vertices, edges)


def test_topics(topical):
    authority = topics.topic_authority(topics.topic_counts(topical.edges))
    assert nested(authority.collect(), "id", "topic", "authority") == {
        1: {"b": 0.15019}, 2: {"a": 0.15019, "b": 0.15019}, 3: {"a": 0.300381, "b": 0.050063}, 5: {"b": 0.15019}, 7: {"a": 0.15019}
    }
    one = nested(topics.topical_scores(topical, "a", 1).collect(), "id", "target", "score")
    assert one == {1: {2: 0.018774, 3: 0.037548}, 2: {3: 0.037548}, 3: {1: 0}, 4: {3: 0.037548, 5: 0}, 6: {7: 0.018774}}
    two = nested(topics.topical_scores(topical, "a", 2).collect(), "id", "target", "score")
    assert two == {
        1: {1: 0.037548, 2: 0.018774, 3: 0.065708}, 2: {1: 0.037548, 3: 0.037548}, 3: {1: 0, 2: 0.004693, 3: 0.009387},
        4: {1: 0.037548, 3: 0.037548, 5: 0}, 6: {7: 0.018774},
    }
