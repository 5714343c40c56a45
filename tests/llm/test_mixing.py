import math

import pytest
from pyspark.sql import functions as F

from blockwalk.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def water_level(sizes, weights, limit=3):
    """The rule as stated: give by weight, stop at the limit, reshare until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, by = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / by > limit * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / by for s in free}
        fixed |= {s: limit * sizes[s] for s in over}


def make(spark, words, per_source):
    rows, i = [], 0
    for source, lengths in per_source.items():
        for n in lengths:
            rows.append((i, words(n), source, "x", 9))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_words_taken(spark, words):
    rng = words.rng
    per_source = {f"s{k}": [int(rng.lognormvariate(3, 1)) + 1 for _ in range(80)] for k in range(7)}
    per_source["tiny"] = [3, 4]
    per_source[None] = [10] * 50
    docs = make(spark, words, per_source)
    got = mixing.mix(docs).collect()
    want = water_level({s: sum(v) for s, v in per_source.items()}, (1, 2, 3))
    for source, target in want.items():
        own = [r for r in got if r["source"] == source]
        assert own[0]["target"] == pytest.approx(target)
        assert own[0]["source_size"] == sum(per_source[source])
        taken = sum(r["taken"] for r in own)
        assert 0 <= target - taken <= max(0.02 * target, 12)
        assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in own)
    assert len(got) == docs.count()
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, got))


def test_certain_copies_and_unequal_inclusion(spark, words):
    docs = make(spark, words, {"a": [20] * 400, "b": [20] * 200})
    docs = docs.withColumn("_liked", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, weights=(1, 1), preference=F.col("_liked")).collect()}
    even = sum(got[i] for i in range(0, 400, 2))
    odd = sum(got[i] for i in range(1, 400, 2))
    assert even + odd == 300  # half of 600 documents of equal size
    assert 2.2 < even / odd < 4.2
    # b: expected copies 2.25 and 0.75: two certain copies of the liked ones
    assert all(got[i] in (2, 3) for i in range(400, 600, 2))
    assert all(got[i] in (0, 1) for i in range(401, 600, 2))


def test_inclusion_frequency_follows_lambda(spark, words):
    docs = make(spark, words, {"a": [10] * 60, "b": [10] * 20}).cache()
    hits = [r["copies"] for k in range(6) for r in mixing.mix(docs, weights=(1, 1), seed=f"run{k}").filter("source = 'a'").collect()]
    assert sum(hits) / len(hits) == pytest.approx(2 / 3, abs=0.02)  # 40 of 60 documents' words each time
    assert set(hits) == {0, 1}


def test_nulls_empty_texts_repeated_rows_and_empty_table(spark, words):
    rows = [(1, None, "a", "x", 1), (2, "", "a", "x", 1), (3, " \t", None, "x", 1), (4, "one two", "a", "x", 1)]
    rows += [(4, "one two", "a", "x", 1)] * 2 + [(None, "three", None, "x", 1), (5, "w " * 50_000, "b", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert max(r["size"] for r in got) == 50_000
    assert all(math.isfinite(r["target"]) for r in got)
    assert mixing.mix(docs.limit(0)).collect() == []
    blank = mixing.mix(docs.filter("doc_id <= 3")).collect()
    assert [(r["taken"], r["target"]) for r in blank] == [(0, 0.0)] * 3


def reached(got, max_copies=3):
    """What each source takes against its target; no document above its limit."""
    assert all(r["taken"] <= max_copies * r["size"] for r in got)
    out = {}
    for r in got:
        taken, target, size = out.get(r["source"], (0, r["target"], 0))
        out[r["source"]] = (taken + r["taken"], target, max(size, r["size"]))
    return out


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_hot_null_and_equal_keys_reach_their_targets(spark, words, hot_rows):
    """A source of one key, of null keys, of equal rows: targets within one document, reruns agree."""
    same = words(7)
    rows = [(5, words(words.rng.randint(3, 20)), "hot", "x", 1) for _ in range(300)]
    rows += [(None, words(words.rng.randint(3, 20)), "null", "x", 1) for _ in range(250)]
    rows += [(9, same, "equal", "x", 1)] * 300 + [(None, same, "nulls alike", "x", 1)] * 200
    rows += [(1000 + i, words(12), None, "x", 1) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for preference in (None, mixing.length_class):
        got = mixing.mix(docs, preference=preference, hot_rows=hot_rows).collect()
        assert len(got) == len(rows)
        for taken, target, longest in reached(got).values():
            assert target - longest <= taken <= target
        again = mixing.mix(docs.repartition(5), preference=preference, hot_rows=hot_rows).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_unequal_inclusion_still_fills_the_target(spark, words):
    """Preferred documents stop at the limit and the others get what is left."""
    per_source = {"a": [2] * 200 + [40] * 20, "b": [3] * 10 + [300] * 3, "c": [30] * 100}
    docs = make(spark, words, per_source)
    liked = F.when(F.col("doc_id") % 4 == 0, 50.0).otherwise(1.0)
    for weights in ((1, 5, 1), (1, 1, 1), (6, 1, 1)):
        for preference in (liked, mixing.length_class):
            for taken, target, longest in reached(mixing.mix(docs, weights=weights, preference=preference).collect()).values():
                assert target - longest <= taken <= target + 1e-6
