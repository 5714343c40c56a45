import numpy as np
import pytest

from blockwalk.llm import substring as ss
from blockwalk.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, id string, kept int"


def brute(rows, length):
    """Plain windows in order of start; rows in order of (key, text hash), equal rows one after another."""
    seen, out = set(), []
    for key, text in rows:
        words = (text or "").split()
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            w = tuple(words[s : s + length])
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        out.append((key, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def run(spark, rows, length, hot_rows=None):
    made = ss.remove_repeats(spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA), length=length, hot_rows=hot_rows)
    return made.collect()


def listed(rows):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows), key=str)


def corpus(words):
    rng = words.rng
    passages = [words(n) for n in (20, 21, 25, 60, 200, 19, 12)]
    rows = []
    for k in range(120):
        parts = [words(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages).split()
            if rng.random() < 0.4:
                p = p[rng.randint(0, 5) : len(p) - rng.randint(0, 5)]
            if rng.random() < 0.3 and p:
                p[rng.randrange(len(p))] = "changed"
            parts += [" ".join(p), words(rng.randint(0, 30))]
        rows.append((k, "\n ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, " \t"), (205, "a " * 300), (206, "a b " * 150), (207, "a " * 19), (208, words(4000) + " " + passages[4])]
    return rows


@pytest.mark.parametrize("hot_rows", [None, 5])
@pytest.mark.parametrize("length", [20, 9])
def test_equals_plain_windows(spark, words, length, hot_rows):
    rows = corpus(words)
    assert listed(run(spark, rows, length, hot_rows)) == sorted(brute(rows, length), key=str)


def test_repeats_are_maximal_spans(spark, words):
    passage, rows = words(50), []
    rows = [(1, f"{words(30)} {passage} {words(30)}"), (2, f"{words(10)} {passage} {words(10)}"), (3, passage)]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["repeats"]] for r in run(spark, rows, 20)}
    assert got == {1: [], 2: [(10, 60)], 3: [(0, 50)]}


def test_repeated_keys_and_equal_rows(spark, words):
    """Equal rows: one stays. Texts of one key are ordered by their hash; null keys come last."""
    a, b = words(40), words(40)
    rows = [(7, a)] * 5 + [(None, a), (None, b), (None, b), (9, words(30)), (9, a + " " + words(25)), (4, "too short"), (4, "too short")]
    for hot_rows in (None, 2):
        got = run(spark, rows, 20, hot_rows)
        assert len(got) == len(rows)
        sevens = sorted(r["n_removed"] for r in got if r["doc_id"] == 7)
        nulls = sorted((r["kept"], r["n_removed"]) for r in got if r["doc_id"] is None)
        assert sevens == [0, 40, 40, 40, 40]
        assert nulls == sorted([("", 40), ("", 40), (b, 0)])
        assert [r["kept"] for r in got if r["doc_id"] == 4] == ["too short"] * 2


def test_same_key_other_texts(spark, words):
    """Two texts of one key that share a passage: exactly one of them keeps it."""
    passage = words(30)
    got = run(spark, [(1, passage + " " + words(5)), (1, words(5) + " " + passage)], 20)
    assert sorted(r["n_removed"] for r in got) == [0, 30]


def test_a_passage_in_every_document(spark, words):
    passage = words(22)
    rows = [(k, f"{words(25)} {passage} {words(25)}") for k in range(300)]
    assert listed(run(spark, rows, 20, 10)) == sorted(brute(rows, 20), key=str)


def test_empty_table_and_bad_length(spark):
    assert run(spark, [], 20) == []
    with pytest.raises(ValueError):
        run(spark, [(1, "a")], 0)


def test_equal_windows_pick_equal_seeds(words):
    text = words(300).split()
    h = ss._hashed([w.encode() for w in text])
    first, count, seed, _ = ss.stretches(h, 20)
    assert count.sum() == len(text) - 19
    of_window = np.repeat(seed, count)
    for s in (0, 17, 280):
        alone = ss.stretches(h[s : s + 20], 20)
        assert alone[1].tolist() == [1] and alone[2][0] == of_window[s]


def test_query_over_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in QUERIES["op13_substring_dedup"](spark, "/root/testdata/sf0.001").collect()}
    import hashlib

    for key, n, removed, kept in brute([tuple(r) for r in table], 20):
        assert (got[key]["n_words"], got[key]["n_removed"], got[key]["kept_sha256"]) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())
