"""Readers and writers through real files."""

import pytest
from pyspark.sql import functions as F

from blockwalk import from_edges
from blockwalk.operators import algorithms, strategies
from blockwalk.sources import (
    read_attr_edges,
    read_block_representatives,
    read_edges,
    read_labeled_edges,
    read_partitioned_edges,
    read_seed_distances,
    read_seeds,
    read_topic_edges,
    sample_vertices,
    save_vertices,
    write_block_representatives,
    write_partitioned_edges,
    write_seed_distances,
    write_seeds,
)
from blockwalk.sources.edge_lists import name_edges
from blockwalk.sources.partitions import read_edge_files


def write(path, text):
    path.write_text(text)
    return str(path)


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_edge_lists(spark, tmp_path):
    plain = write(tmp_path / "e.txt", "# head\n1 2\n\n3\t4\n 5   6 \n7\n")
    assert tuples(read_edges(spark, plain)) == [(1, 2), (3, 4), (5, 6)]
    attr = write(tmp_path / "a.txt", "1 x 2\n3 4\n#\n5\ty\t6\n")
    assert tuples(read_attr_edges(spark, attr)) == [(1, "x", 2), (5, "y", 6)]
    topic = write(tmp_path / "t.txt", "1\t2\ta, b\n3\t4\tc\n5\t6\n")
    assert [(r["src"], r["dst"], r["topics"]) for r in read_topic_edges(spark, topic).orderBy("src").collect()] == [
        (1, 2, ["a", "b"]), (3, 4, ["c"])
    ]


def test_labeled_edges(spark, tmp_path):
    path = write(tmp_path / "l.txt", "ann knows bob\nbob likes cat\nann knows\n# x y z\ncat knows ann\n")
    vertices, edges = read_labeled_edges(spark, path)
    assert {r["name"] for r in vertices.collect()} == {"ann", "bob", "cat"}
    assert vertices.select("id").distinct().count() == 3
    named = name_edges(edges, vertices).select("src_name", "attr", "dst_name")
    assert tuples(named) == [("ann", "knows", "bob"), ("bob", "likes", "cat"), ("cat", "knows", "ann")]


def test_seed_files(spark, tmp_path):
    path = write(tmp_path / "s.txt", "4\t2.5\n7\n\n9 \t 1e3\n")
    seeds = read_seeds(spark, path)
    assert tuples(seeds) == [(4, 2.5, 0), (7, 100000.0, 1), (9, 1000.0, 2)]
    write_seeds(seeds, str(tmp_path / "out"))
    assert tuples(read_seeds(spark, str(tmp_path / "out"))) == tuples(seeds)


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_partition_files(spark, micro, tmp_path, hot_rows):
    placed = strategies.edge_partition_1d(micro.edges, 3, "affine")
    write_partitioned_edges(placed, str(tmp_path / "p"), hot_rows=hot_rows)
    back = read_partitioned_edges(spark, str(tmp_path / "p"))
    assert tuples(back.select("src", "dst", "part")) == tuples(placed.select("src", "dst", "part"))
    kept = strategies.as_loaded(back)
    assert kept is back
    with pytest.raises(ValueError):
        strategies.as_loaded(micro.edges)


def test_flat_edge_files(spark, tmp_path):
    for name, text in {"b.txt": "1 2\n", "a.txt": "3 4\n#\n5 6\n", "c.txt": "7\t8\n"}.items():
        write(tmp_path / name, text)
    assert tuples(read_edge_files(spark, str(tmp_path))) == [(1, 2, 1), (3, 4, 0), (5, 6, 0), (7, 8, 2)]


@pytest.mark.parametrize("form", ["parquet", "text"])
def test_result_tables(spark, tmp_path, form):
    distances = spark.createDataFrame([(4, 10, 11111.11111111111), (4, 1, 48148.148148148146), (5, -3, 1.5)], "id long, seed long, score double")
    write_seed_distances(distances, str(tmp_path / "d"), form)
    assert tuples(read_seed_distances(spark, str(tmp_path / "d"), form)) == tuples(distances)
    marks = spark.createDataFrame([(12, 13, -1), (1, 2, 7)], "src long, dst long, seed long")
    write_block_representatives(marks, str(tmp_path / "r"), form)
    assert tuples(read_block_representatives(spark, str(tmp_path / "r"), form)) == tuples(marks)


def test_text_forms_as_documented(spark, tmp_path):
    path = write(tmp_path / "d.txt", "(4,Map(10 -> 1.1, 1 -> 4.8))\n(5,Map())\njunk\n")
    assert tuples(read_seed_distances(spark, path, "text")) == [(4, 1, 4.8), (4, 10, 1.1)]
    path = write(tmp_path / "r.txt", "((12,13),-1)\nx\n")
    assert tuples(read_block_representatives(spark, path, "text")) == [(12, 13, -1)]


def test_save_and_sample(spark, tmp_path):
    graph = from_edges(spark, [(i, i + 1) for i in range(1, 2000)])
    ranks = algorithms.pagerank(graph, 1)
    save_vertices(ranks, str(tmp_path / "v"), "json")
    assert spark.read.json(str(tmp_path / "v")).count() == 2000
    sample = sample_vertices(ranks, 0.1, 3)
    assert 120 < sample.count() < 280
    assert sample.join(ranks, ["id", "rank"], "left_anti").isEmpty()
    assert ranks.agg(F.min("rank")).first()[0] == 0.15
