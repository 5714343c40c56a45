import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from blockwalk.llm import prefix_trie as pt
from blockwalk.llm.queries import QUERIES, rebuilt_conversations

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n int"


def brute(sequences):
    """{conv: [(role, text), ...]} to the rows of the trie, from plain dictionaries."""
    members = {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids, rows = {}, []
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves = 0 if p in kids else 1
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for k in kids.get(p, ()):
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    for p, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(sequences[c]) == len(p))))
        rows.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids.get(p, ())), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def run(spark, sequences, hot_rows=None):
    rows = [(c, t, r, x, "z", 1) for c, seq in sequences.items() for t, (r, x) in enumerate(seq)]
    turns = pt.ordered_turns(spark.createDataFrame(rows, SCHEMA), hot_rows=hot_rows)
    convs = spark.createDataFrame([(c,) for c in sequences], "conv long")
    return sorted((tuple(r) for r in pt.prefix_trie(turns, convs, hot_rows).collect()), key=str)


def conversations(rng, n, alphabet, longest):
    return {c * 3 - 7: [(rng.choice(("user", "bot")), rng.choice(alphabet)) for _ in range(rng.randint(0, longest))] for c in range(n)}


@pytest.mark.parametrize("hot_rows", [None, 4])
@pytest.mark.parametrize(("n", "alphabet", "longest"), [(60, ["a", "bé", ""], 11), (80, ["x"], 14), (40, ["p", "qq", "rrr", "ssss"], 5)])
def test_equals_plain_dictionaries(spark, words, n, alphabet, longest, hot_rows):
    made = conversations(words.rng, n, alphabet, longest)
    some = list(made.values())
    made |= {1000 + i: list(some[i % 5]) for i in range(30)}
    assert run(spark, made, hot_rows) == brute(made)


def test_a_conversation_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(pt, "_CHUNK", 8)
    long = [("u", str(i % 7)) for i in range(60)]
    made = {5: long, 2: long[:33], 9: [*long[:20], ("u", "other")], 4: []}
    assert run(spark, made, 10) == brute(made)


def test_roles_and_texts_do_not_run_together(spark):
    made = {1: [("a", "bc")], 2: [("ab", "c")], 3: [("1:a", "")], 4: [("", "1:a")]}
    assert run(spark, made) == brute(made)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, 1, "u", "b", "z", 1), (1, None, "u", None, "z", 1), (1, 1, "u", "a", "z", 1), (2, 0, None, "", "z", 1), (None, 0, "u", "x", "z", 1), (3, 1, "u", "a", "z", 1), (3, 1, "u", "b", "z", 1), (3, None, "u", "", "z", 1)]
    turns = pt.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    got = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("m")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, 3), (2, 1, 1), (3, 3, 3)]
    trie = pt.prefix_trie(turns, turns.select("conv")).collect()
    assert {(r["conv_id"], r["depth"], r["n_convs"]) for r in trie} == {(1, 0, 3), (2, 1, 1), (1, 1, 2), (1, 2, 2), (1, 3, 2)}
    none = spark.createDataFrame([], SCHEMA)
    assert pt.prefix_trie(pt.ordered_turns(none), pt.ordered_turns(none).select("conv")).collect() == []


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((-1 if t is None else t, hashlib.md5(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest(), r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + seq[h:]
    return out


def test_query_over_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_prefix_trie"](spark, sf).collect()), key=str)
    assert got == brute(rebuilt(rows))


def test_rebuilding(spark, words):
    rng = words.rng
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(("u", None)), rng.choice(("a", "b", None)), "z", 1) for c in range(-12, 40) if c % 7 for t in range(rng.randint(1, 12))]
    turns, convs = rebuilt_conversations(spark.createDataFrame(rows, SCHEMA), hot_rows=20)
    got = sorted((tuple(r) for r in pt.prefix_trie(turns, convs, 20).collect()), key=str)
    assert got == brute(rebuilt([r[:4] for r in rows]))
