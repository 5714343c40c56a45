import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwalk.llm import hard_negatives as hn
from blockwalk.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<long>, label int, rank string, q int"


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    rows = [r for r in rows if None not in r[:3] and None not in r[1]]
    out = []
    for i, (a, v, mine) in enumerate(rows):
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, k) for k, (b, w, _) in enumerate(rows) if len(w) == len(v))
        best = [(s, b) for s, b, k in scored if rows[k][2] == mine and k != i][:positives]
        for s, b in best:
            fits = [(t, c) for t, c, k in scored if rows[k][2] != mine and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, b, n, c, -s, -t) for n, (t, c) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, **more):
    made = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = hn.mine(made, F.col("vec_id") % 10 == 0, **more).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def clustered(seed, n, dim=6, labels=4):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-200, 200, (9, dim))
    rows = [(k, (centers[rng.integers(9)] + rng.integers(-30, 30, dim)).tolist(), int(rng.integers(labels))) for k in range(n)]
    return rows + [(n + k, rows[k][1], rows[k][2]) for k in range(30)]


@pytest.mark.parametrize("limits", [(hn.TILE, hn.COLUMN), (7, 40)])
def test_equals_all_scores(spark, monkeypatch, limits):
    monkeypatch.setattr(hn, "TREE", 16)
    rows = clustered(3, 400)
    assert run(spark, rows, limits=limits) == brute(rows, lambda a: a % 10 == 0)


def test_few_rows_of_a_label_and_small_counts(spark):
    rows = [(0, [5, 5], 1), (1, [4, 5], 1), (2, [1, 1], 2), (3, [2, 1], 2), (10, [-3, 1], 3), (20, [0, 0], 1)]
    for p, n in ((1, 1), (5, 10), (2, 3)):
        assert run(spark, rows, positives=p, negatives=n) == brute(rows, lambda a: a % 10 == 0, p, n)


def test_nulls_repeats_ties_and_lengths(spark):
    rows = clustered(5, 60) + [(None, [1] * 6, 1), (100, None, 1), (110, [1, None, 1, 1, 1, 1], 1), (120, [1] * 6, None), (130, [], 1), (131, [], 1), (132, [], 2), (140, [9, 9], 1), (141, [9, 8], 1), (142, [5, 3], 0)]
    rows += [(30, rows[30][1], rows[30][2])] * 3 + [(7, rows[8][1], 2)] * 2
    assert run(spark, rows) == brute(rows, lambda a: a % 10 == 0)


def test_empty_table_and_no_anchor(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1, 2], 0), (2, [2, 2], 1)]) == []


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.integers(-(1 << 28), 1 << 28, 5).tolist(), int(rng.integers(3))) for k in range(80)]
    rows += [(k, [x * (1 << 2) + 1 for x in rows[k % 80][1]], 1) for k in range(80, 90)]
    assert run(spark, rows) == brute(rows, lambda a: a % 10 == 0)


def test_bounds_spare_scores():
    """Near copies of an anchor are bounded through it instead of being scored again."""
    rng = np.random.default_rng(2)
    centers = rng.integers(-300, 300, (12, 32))
    near = centers[np.arange(200) % 12] + rng.integers(-2, 3, (200, 32))
    rows = centers[rng.integers(0, 12, 3000)] + rng.integers(-2, 3, (3000, 32))
    label = np.arange(200) % 12
    search = hn.Anchors(near, np.arange(200), label, None, 5)
    search.meet(rows, np.arange(1000, 4000), np.arange(1000, 4000), rng.integers(0, 12, 3000))
    assert search.scored < 0.1 * 200 * 3000


def test_the_tree_is_minimal_and_in_order():
    points = np.array([[0.0], [10], [1], [12], [4]])
    order, parent, length = hn.spanning_tree(points)
    assert order.tolist() == [0, 2, 4, 1, 3]
    assert length.tolist() == [0, 1, 3, 6, 2]
    assert all(p < k for k, p in enumerate(parent) if k)


def test_query_over_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        if r["label"] is None or r["embedding"] is None or not all(x is not None and np.isfinite(x) for x in r["embedding"]):
            continue
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        rows.append((r["vec_id"], np.floor(256 * np.array(r["embedding"], np.float64)).astype(int).tolist(), label))
    got = QUERIES["op11_hard_negatives"](spark, sf).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda a: a % 100 == 0)
