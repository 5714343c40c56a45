"""Tables that grow to the square of the vertices, limited to given rows or columns; large top lists."""

import random

import pytest
from helpers import random_pairs
from pyspark.sql import functions as F

from blockwalk import Graph, from_edges
from blockwalk.operators import ppr, relational, seeds, topics
from blockwalk.sources import results


def table(rows, *keys):
    return {tuple(r[k] for k in keys): r["score"] for r in rows}


def close(got, want, by=1e-12):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - v) <= by for k, v in want.items())


@pytest.fixture(scope="module")
def graph(spark):
    return from_edges(spark, random_pairs(7, 40, 130, 0.2))


@pytest.mark.parametrize("mode", ["exact", "recurrence"])
@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_doubling_toward_targets_is_part_of_the_whole(spark, graph, mode, rounds):
    wanted = spark.createDataFrame([(1,), (5,), (9,), (9,), (999,)], "id long")
    whole = table(ppr.inverse_p_distance_doubling(graph, rounds, mode=mode).collect(), "id", "target")
    got = table(ppr.inverse_p_distance_doubling(graph, rounds, mode=mode, targets=wanted).collect(), "id", "target")
    close(got, {k: v for k, v in whole.items() if k[1] in (1, 5, 9)})


def test_doubling_states_its_error(graph):
    exact = table(ppr.inverse_p_distance_doubling(graph, 3).collect(), "id", "target")
    for floor in (1e-5, 1e-3, 1e-2):
        report = []
        got = table(ppr.inverse_p_distance_doubling(graph, 3, floor=floor, report=report).collect(), "id", "target")
        assert len(got) < len(exact) and report[-1]["rows"] == len(got)
        assert [r["error"] for r in report] == sorted(r["error"] for r in report)
        worst = max(v - got.get(k, 0.0) for k, v in exact.items())
        assert 0 < worst <= report[-1]["error"] + 1e-15


@pytest.fixture(scope="module")
def topical(spark, graph):
    rng = random.Random(3)
    labels = graph.edges.collect()
    rows = [(r["edge_id"], r["src"], r["dst"], rng.sample(["a", "b", "c"], rng.randint(0, 2))) for r in labels]
    return Graph(graph.vertices, spark.createDataFrame(rows, "edge_id long, src long, dst long, topics array<string>"))


@pytest.mark.parametrize("hot_rows", [None, 8])
@pytest.mark.parametrize("iterations", [1, 2, 4])
def test_topical_rows_and_columns_are_part_of_the_whole(spark, topical, iterations, hot_rows):
    similar = spark.createDataFrame([("b", "a", 0.8), ("c", "a", 0.1), ("a", "a", 1.0), ("a", "b", 0.3)], "topic_a string, topic_b string, value double")
    some = spark.createDataFrame([(1,), (4,), (4,), (30,)], "id long")
    whole = table(topics.topical_scores(topical, "a", iterations, similar=similar).collect(), "id", "target")
    rows = table(topics.topical_scores_from(topical, "a", some, iterations, similar=similar, hot_rows=hot_rows).collect(), "id", "target")
    close(rows, {k: v for k, v in whole.items() if k[0] in (1, 4, 30)})
    columns = table(topics.topical_scores(topical, "a", iterations, similar=similar, targets=some).collect(), "id", "target")
    close(columns, {k: v for k, v in whole.items() if k[1] in (1, 4, 30)})


@pytest.mark.parametrize("hot_rows", [None, 12])
def test_topical_blocks_of_readers_and_targets_give_every_row(spark, monkeypatch, hot_rows):
    rng = random.Random(5)
    pairs = [(rng.randint(1, 40), rng.randint(1, 40)) for _ in range(150)] + [(v, 7) for v in range(20, 40)]
    pairs += [(3, 3), (4, None), (9, None), (None, 4)]
    edges = spark.createDataFrame([(i, s, d, ["a"]) for i, (s, d) in enumerate(pairs)], "edge_id long, src int, dst int, topics array<string>")
    authority = {v: v / 100 for v in range(1, 41) if v % 3}
    known = spark.createDataFrame([(k, "a", v) for k, v in authority.items()], "id int, topic string, authority double")
    worth = lambda d: 0.5 * 0.5 * authority.get(d, 0.0) * 0.5
    direct = {}
    for s, d in pairs:
        direct[s, d] = direct.get((s, d), 0.0) + worth(d)
    want = dict(direct)
    for _ in range(2):
        rows = {k: v for k, v in direct.items() if k[0] is not None}
        for s, d in pairs:
            for (m, t), score in want.items() if s is not None and d is not None else ():
                if m == d:
                    rows[s, t] = rows.get((s, t), 0.0) + score * 0.25
        for (s, d), r in direct.items():
            for t in {t for m, t in want if m == d} if s is not None and d is not None else ():
                rows[s, t] += r
        want = rows
    monkeypatch.setattr(topics, "ENTRIES", 9)
    monkeypatch.setattr(topics, "ROWS_PER_BLOCK", 200)
    graph = Graph(edges.select(F.col("src").alias("id")).distinct(), edges, hot_rows)
    found = topics.topical_scores(graph, "a", 3, authority=known)
    assert [f.dataType.simpleString() for f in found.schema] == ["int", "int", "double"]
    got = found.collect()
    assert len(got) == len(want)
    close(table(got, "id", "target"), want)
    if hot_rows is None:
        # the blocks are read where they were written: nothing moves for each reader
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


def test_similarity_in_the_row_and_by_join_agree(spark, topical, monkeypatch):
    similar = spark.createDataFrame([("b", "a", 0.8), ("c", "a", None), ("a", "a", 1.0)], "topic_a string, topic_b string, value double")
    inside = {r["edge_id"]: r["similarity"] for r in topics.topic_similarity(topical.edges, "a", similar).collect()}
    monkeypatch.setattr(topics, "_FEW", 1)
    joined = {r["edge_id"]: r["similarity"] for r in topics.topic_similarity(topical.edges, "a", similar).collect()}
    assert inside == joined and set(inside.values()) == {0.5, 0.8, 1.0}


def test_long_top_lists_pass_through_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(relational, "DIRECT_ROWS", 20)
    rng = random.Random(1)
    rows = [(k, rng.randint(1, 30)) for k in range(900)]
    order = [F.desc("n"), F.asc("id")]
    got = relational.top_n(spark.createDataFrame(rows, "id long, n int").repartition(6), 300, order).collect()
    assert sorted(r["id"] for r in got) == sorted(k for k, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:300])
    assert relational.top_n(spark.createDataFrame(rows[:50], "id long, n int"), 300, order).count() == 50
    edges = from_edges(spark, random_pairs(2, 90, 300)).edges
    near = {r["id"]: r["degree"] for r in relational.degrees(edges).collect()}
    want = sorted(near, key=lambda v: (-near[v], -v))[:40]
    assert sorted(r["seed"] for r in seeds.top_degree_seeds(edges, 40).collect()) == sorted(want)


def test_triplets_move_the_edges_once(spark, graph):
    rows = relational.triplets(Graph(graph.vertices.withColumn("v", F.col("id") * 2), graph.edges), ["v"])
    assert all(r["src_v"] == 2 * r["src"] and r["dst_v"] == 2 * r["dst"] for r in rows.collect())
    assert rows.count() == graph.edges.count()
    wide = Graph(graph.vertices.withColumn("v", F.col("id") * 2), graph.edges.withColumn("w", F.lit(1)))
    assert {"w", "src_v", "dst_v"} <= set(relational.triplets(wide, ["v"]).columns)


def test_a_text_line_does_not_hold_a_long_list(spark):
    rows = spark.range(50).selectExpr("1L AS id", "id AS seed", "1.0D AS score")
    assert results.seed_distances_to_lines(rows, 50).count() == 1
    with pytest.raises(ValueError):
        results.seed_distances_to_lines(rows, 49)
