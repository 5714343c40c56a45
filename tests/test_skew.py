"""Hot keys: a hub owning over a third of all edges must change nothing but the plan.

``hot_rows=5`` makes every busy vertex hot on a small graph, so the split, copied, range
numbered and broadcast branches all run; results are compared with the plain branches.
"""

import pytest
from helpers import random_pairs
from pyspark.sql import functions as F

from blockwalk import Graph, from_edges, with_edge_ids
from blockwalk.operators import algorithms, balance, blocks, metrics, ppr, relational, topics, walks
from blockwalk.operators.seeds import top_degree_seeds
from blockwalk.skew import (
    every_slot, hot_keys, in_chunks, join_both, join_known, join_small, join_spread, join_unique, lead_within, number_all, number_within, with_slot,
)

HOT = 5


@pytest.fixture(scope="module")
def plain(spark):
    return from_edges(spark, random_pairs(7, 40, 240, hub_share=0.4))


@pytest.fixture(scope="module")
def hot(plain):
    return Graph(plain.vertices, plain.edges, HOT)


def rows(df):
    df = df.select(*[
        F.col(c).cast("float").alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ])
    return sorted(df.collect(), key=str)


def test_key_hot_on_both_sides_gets_a_grid(spark):
    left = spark.range(400).select(F.when(F.col("id") < 330, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.when(F.col("id") < 250, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))
    hot_left, hot_right = hot_keys(left, ["k"], 50), hot_keys(right, ["k"], 50)
    assert rows(join_known(left, right, ["k"], hot_left, hot_right)) == rows(left.join(right, "k"))
    cells = every_slot(with_slot(left, hot_left, "row"), hot_right, "column").groupBy("row", "column").count().collect()
    assert len(cells) == 7 * 5 and max(r["count"] for r in cells) < 90  # 330 rows over 7 slots, whatever the other side
    cells = every_slot(with_slot(right, hot_right, "column"), hot_left, "row").groupBy("row", "column").count().collect()
    assert max(r["count"] for r in cells) < 90


def test_state_and_edges_hot_at_one_vertex(plain, hot):
    state = plain.vertices.crossJoin(plain.vertices.select(F.col("id").alias("seed")).limit(9)).withColumn("id", F.least("id", F.lit(6)))
    one, two = (g.links("out").join(state, many=True).select("at", "to", "seed", "edge_id") for g in (plain, hot))
    assert rows(one) == rows(two)


def test_hot_keys_are_found(plain):
    found = hot_keys(plain.edges, ["src"], HOT)
    counts = {r["src"]: r["count"] for r in plain.edges.groupBy("src").count().collect()}
    assert {r["src"] for r in found.table.collect()} == {s for s, n in counts.items() if n > HOT}
    assert all(r["fan"] == -(-counts[r["src"]] // HOT) for r in found.table.collect())
    assert hot_keys(plain.edges, ["src"], 1000) is None


def test_joins(plain):
    left = plain.edges
    one = plain.vertices.filter("id % 3 > 0").select(F.col("id").alias("src"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        assert rows(join_unique(left, one, ["src"], how, HOT)) == rows(left.join(one, "src", how))
    many = left.select("src", F.col("dst").alias("other"))
    assert rows(join_spread(left, many, ["src"], HOT)) == rows(left.join(many, "src"))
    # the right side owns the hot key
    few = left.filter("edge_id % 9 = 0")
    assert rows(join_both(few, many, ["src"], None, HOT)) == rows(few.join(many, "src"))
    hot_left = hot_keys(left, ["src"], 20)
    assert rows(join_both(left, many, ["src"], hot_left, HOT)) == rows(left.join(many, "src"))
    for how in ("left_semi", "left_anti"):
        assert rows(join_unique(left, one, ["src"], how, HOT)) == rows(left.join(one, "src", how))
        assert rows(join_small(left, one, 10**9, ["src"], how)) == rows(left.join(one, "src", how))
    plan = join_spread(left, many, ["src"], HOT)._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" in plan


def test_numbering(plain):
    order = [F.desc("dst"), F.asc("edge_id")]
    split = number_within(plain.edges, ["src"], order, "n", HOT)
    assert rows(split) == rows(number_within(plain.edges, ["src"], order, "n"))
    after = lead_within(plain.edges, ["src"], [F.col("edge_id")], "dst", "next", HOT)
    assert rows(after) == rows(lead_within(plain.edges, ["src"], [F.col("edge_id")], "dst", "next"))
    numbered = number_all(plain.edges, [F.desc("dst"), F.asc("edge_id")], "n", 1).orderBy("n").collect()
    assert [r["n"] for r in numbered] == list(range(1, 241))
    assert [(-r["dst"], r["edge_id"]) for r in numbered] == sorted((-r["dst"], r["edge_id"]) for r in numbered)


def test_identical_rows_are_numbered_apart(spark):
    same = spark.range(50).select(F.lit(3).alias("src"), F.lit(4).alias("dst"))
    assert sorted(r["n"] for r in number_all(same, [F.col("src"), F.col("dst")], "n", total=False).collect()) == list(range(50))


def test_multigraph_edge_ids(spark):
    pairs = spark.createDataFrame([(2, 1), (1, 2), (1, 2), (1, 1), (1, 2)], "src long, dst long")
    got = with_edge_ids(pairs).orderBy("edge_id").collect()
    assert [(r["edge_id"], r["src"], r["dst"]) for r in got] == [(1, 1, 1), (2, 1, 2), (3, 1, 2), (4, 1, 2), (5, 2, 1)]


def test_lists_are_chunked(plain):
    listed = in_chunks(plain.edges, ["src"], F.col("edge_id"), [F.col("edge_id")], "ids", chunk=7, hot_rows=HOT).collect()
    assert max(len(r["ids"]) for r in listed) == 7
    whole = {}
    for r in sorted(listed, key=lambda r: (r["src"], r["chunk"])):
        whole.setdefault(r["src"], []).extend(r["ids"])
    want = {}
    for r in plain.edges.orderBy("edge_id").collect():
        want.setdefault(r["src"], []).append(r["edge_id"])
    assert whole == want


@pytest.fixture(scope="module")
def seeds(plain):
    return top_degree_seeds(plain.edges, 4).cache()


def test_blocks(plain, hot, seeds):
    a, b = (blocks.propagate(g, seeds, 3, 2).cache() for g in (plain, hot))
    assert rows(a) == rows(b)
    pa, pb = (blocks.edge_profiles(g, s, 3) for g, s in ((plain, a), (hot, b)))
    assert rows(blocks.edge_candidates(pa)) == rows(blocks.edge_candidates(pb))
    assert rows(balance.capped_assign(pa, seeds)) == rows(balance.capped_assign(pb, seeds, hot_rows=HOT))
    assert rows(balance.partial_reschedule(pa, seeds)) == rows(balance.partial_reschedule(pb, seeds, hot_rows=HOT))


def test_capped_assign_with_no_space_between_the_lines(plain, seeds, monkeypatch):
    profiles = blocks.edge_profiles(plain, blocks.propagate(plain, seeds, 3, 2), 3)
    want = rows(balance.capped_assign(profiles, seeds, 20))
    monkeypatch.setattr(balance, "_NEAR", 0)
    assert rows(balance.capped_assign(profiles, seeds, 20, hot_rows=HOT)) == want


@pytest.mark.parametrize("job", [
    lambda g: algorithms.pagerank(g, 4),
    algorithms.connected_components,
    algorithms.triangle_count,
    lambda g: algorithms.shortest_paths(g, g.vertices.filter("id in (1, 9)")),
    lambda g: ppr.inverse_p_distance(g, 2),
    lambda g: ppr.inverse_p_distance_doubling(g, 2),
    lambda g: ppr.message_elements(g, 2),
    lambda g: walks.walk_ids(g, 3, 4),
    lambda g: walks.hub_walks(g, g.vertices.filter("id < 4").select(F.col("id").alias("seed"), F.lit(1.0).alias("value")), (2, 4)),
    lambda g: walks.random_neighbor(
        g.vertices.select(F.col("id").alias("source"), F.lit(1).alias("walk"), F.lit(1).cast("long").alias("current")), g),
    lambda g: relational.triplets(g, []),
], ids=["pagerank", "components", "triangles", "paths", "ppr", "doubling", "elements", "walks", "hubs", "neighbor", "triplets"])
def test_jobs(plain, hot, job):
    assert rows(job(plain)) == rows(job(hot))


def test_topics(plain):
    labels = plain.edges.withColumn("topics", F.array(F.concat(F.lit("t"), (F.col("dst") % 3).cast("string"))))
    a = topics.topical_scores(Graph(plain.vertices, labels), "t1", 2)
    b = topics.topical_scores(Graph(plain.vertices, labels, HOT), "t1", 2, hot_rows=HOT)
    assert rows(a) == rows(b)


def test_traffic(plain, seeds):
    labels = blocks.assign_blocks(blocks.edge_profiles(plain, blocks.propagate(plain, seeds, 3, 2), 2)).cache()
    scores = blocks.propagate(plain, seeds, 3, 2)
    paths = walks.walk_segments(plain, 2, 3).cache()
    visits = metrics.visit_counts(paths)
    marks = blocks.block_representatives(labels)
    a = metrics.visits_by_distance(visits, scores, labels, marks, 5, part="block")
    b = metrics.visits_by_distance(visits, scores, labels, marks, 5, part="block", hot_rows=HOT)
    assert rows(a) == rows(b)
    assert rows(metrics.walk_sources(paths, 3)) == rows(metrics.walk_sources(paths, 3, HOT))
