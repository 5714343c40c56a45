"""End-to-end partitionings and reports."""

import time

import pytest
from helpers import flat, random_pairs
from pyspark.sql import functions as F

from blockwalk import Graph, build_graph, from_edges, graph as graphs, message_step, runtime, skew, with_edge_ids
from blockwalk.functions.scores import merge_arrays
from blockwalk.operators import algorithms, metrics, relational, topics, walks
from blockwalk.operators.seeds import top_degree_seeds
from blockwalk.plans import METHODS, compare_partitionings, label_blocks, partition_edges, walk_traffic
from contract import queries, tables


@pytest.fixture(scope="module")
def graph(spark):
    return from_edges(spark, random_pairs(11, 80, 320, 0.2))


@pytest.fixture(scope="module")
def seeds(graph):
    return runtime.cut(top_degree_seeds(graph.edges, 8))


@pytest.fixture(scope="module")
def labels(graph, seeds):
    return label_blocks(graph, seeds, 3, 4)


@pytest.mark.parametrize("method", METHODS)
def test_every_edge_is_placed_once(graph, seeds, labels, method):
    placed = partition_edges(graph, seeds, 3, 4, method, parts=3, inter_fac=0.95, labels=labels)
    rows = placed.collect()
    assert sorted(r["edge_id"] for r in rows) == list(range(1, 321))
    parts = {r["part"] for r in rows}
    assert parts <= ({0, 1, 2} if method in ("lpt", "overlap") else set(range(-1, 8)))
    factor = metrics.replication_factor(placed).first()["factor"]
    assert 1 <= factor <= len(parts)


def test_unknown_method(graph, seeds):
    with pytest.raises(ValueError):
        partition_edges(graph, seeds, 1, 1, "hash")
    with pytest.raises(ValueError):
        partition_edges(graph, seeds, 1, 2, "lpt")


def test_reports(graph, seeds, labels):
    placed = partition_edges(graph, seeds, 3, 4, "lpt", parts=3, labels=labels)
    row = walk_traffic(graph, placed, 2, 3).first()
    assert row["factor"] >= 1 and row["messages"] > 0 and row["crossing"] >= 0
    table = compare_partitionings(graph, 3, {"lpt": placed}).collect()
    assert len(table) == 5 and all(r["vertices"] == table[0]["vertices"] for r in table)


def test_custom_rounds(spark, micro):
    # the longest distance from vertex 4, as a user-written step
    start = micro.vertices.select("id", F.when(F.col("id") == 4, 0).alias("far"))

    def step(state, _):
        got = message_step(micro.links("out"), state, {"far": F.col("far") + 1}, {"far": F.max("far")}, active=F.col("far").isNotNull())
        return state.select("id").join(got, "id", "left")

    assert flat(runtime.iterate(start, step, 2).collect(), "id", "far") == {1: 2, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}


def test_work_tables_are_released(spark, micro):
    table = runtime.cut(micro.edges)
    assert runtime.settled(table) is table
    path = table.work_path
    runtime.release(table)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    assert not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    runtime.release(micro.edges)


def test_core_rounds_do_not_move_the_edges(spark, micro):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = micro.vertex_ids().select("id", F.lit(1.0).alias("rank"))
        round_ = message_step(micro.links("out"), state, {"m": F.col("rank") / F.col("out_deg")}, {"m": F.sum("m")})
        plan = round_._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    # one exchange for the state, one for the combined messages, none for the bucketed edges
    assert plan.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in plan and "partial_sum" in plan


def test_relational_pieces(spark, micro):
    edges = micro.edges
    chosen = edges.filter("src = 1").select("edge_id")
    assert relational.subtract_edges(edges, chosen).count() == 5
    assert relational.select_edges(edges, chosen).count() == 2
    both = relational.neighbors(edges, "in").collect()
    assert {r["id"]: r["neighbors"] for r in both}[3] == [1, 2, 4]
    pages = algorithms.static_pagerank(micro, 3).count()
    assert pages == 7


def test_topical_rows_move_once_to_a_block_of_readers(spark, monkeypatch):
    """Rows that readers pull are not dealt out one by one, whatever the number of blocks."""
    edges = from_edges(spark, random_pairs(5, 60, 400)).edges.withColumn("topics", F.array(F.concat(F.lit("t"), (F.col("dst") % 3).cast("string"))))
    whole = topics.topical_scores(build_graph(edges), "t1", 3)
    monkeypatch.setattr(topics, "ROWS_PER_BLOCK", 100)
    monkeypatch.setattr(topics, "WIDE", 250)
    cut_up = topics.topical_scores(build_graph(edges), "t1", 3)
    for frame in (whole, cut_up):
        rows = sorted((r["id"], r["target"], round(r["score"], 9)) for r in frame.collect())
        if frame is whole:
            want = rows
    assert rows == want and len({r[0] for r in want}) > 40
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan and "hashpartitioning(id" not in plan.split("Generate posexplode")[0]


def test_blocks_do_not_write_whole_profiles(spark):
    tables.forget()
    sf_dir = "/root/testdata/sf0.001"
    assert queries.QUERIES["block_representatives"](spark, sf_dir).count() > 0
    assert not any(key[1:] == (sf_dir, "profiles") for key in tables._known)
    tables.forget()


def test_merged_scores_of_one_reached_end(spark):
    kind = "array<struct<seed:bigint,score:double>>"
    rows = [(1, [(4, 2.0), (1, 1.0), (2, 1.0)], None), (2, None, [(3, 5.0), (9, 0.0)]), (3, None, None), (4, [(1, 1.0)], [(2, 3.0), (1, 2.0)])]
    merged = merge_arrays(F.col("a"), F.col("b"), 2)
    frame = spark.createDataFrame(rows, f"id int, a {kind}, b {kind}").select("id", merged.alias("m"))
    got = {r["id"]: [tuple(e) for e in r["m"]] for r in frame.collect()}
    assert got == {1: [(4, 2.0), (1, 1.0)], 2: [(3, 5.0), (9, 0.0)], 3: [], 4: [(1, 3.0), (2, 3.0)]}


def test_degrees_join_in_tasks_of_a_fixed_number_of_rows(spark, monkeypatch):
    edges = from_edges(spark, random_pairs(3, 40, 300, 0.3)).edges
    want = sorted(map(tuple, Graph(None, edges).weighted_edges().collect()))
    monkeypatch.setattr(runtime, "ROWS_PER_TASK", 20)
    assert runtime.by_rows(edges, 300, "src").rdd.getNumPartitions() == 15
    for hot_rows in (None, 5):
        graph = Graph(None, edges, hot_rows)
        dealt = graph.join_end(edges, "src", edges.select("src").distinct(), rows=300)
        assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, graph.weighted_edges().collect())) == want


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_edges_move_once_to_a_layout_and_once_to_the_walks(spark, monkeypatch, hot_rows):
    """Degrees are counted in the layout by source and neighbors numbered there; edges carry no degree
    of their other end to the walks, so no join moves them."""
    edges = from_edges(spark, random_pairs(7, 40, 300, 0.3)).edges
    pairs = [(r["edge_id"], r["src"], r["dst"]) for r in edges.collect()]
    plans, written = {}, []

    def bucketed(df, keys, buckets, *inside):
        plans[tuple(keys)] = df._jdf.queryExecution().executedPlan().toString()
        return runtime.cut_bucketed(df, keys, buckets, *inside)

    monkeypatch.setattr(graphs, "cut_bucketed", bucketed)
    monkeypatch.setattr(walks, "cut_bucketed", bucketed)
    monkeypatch.setattr(graphs, "cut", lambda df: written.append(df.columns) or runtime.cut(df))
    monkeypatch.setattr(walks, "cut", lambda df: written.append(df.columns) or runtime.cut(df))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = build_graph(edges, hot_rows=hot_rows)
        paths = sorted(map(tuple, walks.walk_segments(g, 2, 3).select("source", "walk", "path").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    # all edges are written by the two layouts only; the hot ones also to their slots
    assert all("dst" not in c and ("to" not in c or "slot" in c) for c in written)
    if hot_rows is None:
        assert "Exchange hashpartitioning" not in plans[("src", "idx")] + plans[("at",)]
    degree = {v: sum(1 for _, s, _ in pairs if s == v) for v in {s for _, s, _ in pairs}}
    assert sorted(map(tuple, g.weighted_edges().select("edge_id", "src", "dst", "out_deg").collect())) == sorted((i, s, d, degree[s]) for i, s, d in pairs)
    steps, number = sorted(map(tuple, walks.step_table(g).collect())), {}
    for _, s, d in sorted(pairs, key=lambda e: (e[1], e[2], e[0])):
        number.setdefault(s, []).append(d)
    assert steps == sorted((s, i, d) for s, ds in number.items() for i, d in enumerate(ds))
    assert all(b in number[a] for source, _, path in paths for a, b in zip([source, *path], path))
    assert all(len(path) == 3 or [source, *path][-1] not in number for source, _, path in paths)


def test_ties_of_a_numbering_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(skew, "cut", lambda df: written.append(df.columns) or runtime.cut(df))
    pairs = spark.createDataFrame([(2, 1), (1, 1), (2, 1), (1, 3)] * 5, "src long, dst long")
    got = sorted(map(tuple, with_edge_ids(pairs).select("edge_id", "src", "dst").collect()))
    assert got == [(i + 1, *p) for i, p in enumerate([(1, 1)] * 5 + [(1, 3)] * 5 + [(2, 1)] * 10)]
    assert len(written) == 2 and not any("_tie" in columns for columns in written)


def test_visits_by_distance_leaves_edges_without_a_seed(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (5, 6, -1), (6, 1, -1), (7, 8, 4)], "src long, dst long, block long")
    marks = spark.createDataFrame([(1, 2, 1), (5, 6, -1)], "src long, dst long, seed long")
    scores = spark.createDataFrame([(1, 1, 9.0), (2, 1, 4.0)], "id long, seed long, score double")
    visits = spark.createDataFrame([(i, 10 * i) for i in range(1, 9)], "id long, visits long")
    taken, formed = [], metrics.partition_vertices
    monkeypatch.setattr(metrics, "partition_vertices", lambda e, part: taken.extend(r[part] for r in e.collect()) or formed(e, part))
    got = sorted(map(tuple, metrics.visits_by_distance(visits, scores, edges, marks, 20, part="block").collect()))
    assert got == [(1, 1, 0, 10.0, 1), (1, 1, 1, 20.0, 1), (1, 1, 2, 30.0, 1)]
    assert set(taken) == {1}


def test_shuffle_files_go_with_the_table_that_needed_them(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in (str(x) for x in disk.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}
    before, setting = files(), spark.conf.get(runtime.SHUFFLES_END_CONF)
    frame = spark.range(20_000).withColumn("x", F.xxhash64("id")).repartition(5, "x")
    tables_ = [runtime.cut(frame), runtime.cut_bucketed(frame.select("x"), ["x"], 3)]
    until = time.time() + 20
    while files() - before and time.time() < until:  # they are deleted in the background
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(runtime.SHUFFLES_END_CONF) == setting
    assert [t.count() for t in tables_] == [20_000, 20_000]
    for t in tables_:
        runtime.release(t)
