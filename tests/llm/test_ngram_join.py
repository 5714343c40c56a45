import numpy as np
import pytest

from blockwalk.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, n int, node string, grp long"


def gram_set(text, size):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return set()
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, size, percent):
    sets = [gram_set(t, size) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[top(i)] = top(j)
    low = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            low[top(i)] = min(low.get(top(i), key), key)
    return sorted(((k, len(s), low.get(top(i))) for i, ((k, *_), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        at = rng.randrange(len(w))
        w[at] = rng.choice(["changed", "and", w[rng.randrange(len(w))]])
    return " ".join(w)


def corpus(words):
    rng = words.rng
    rows, k = [], 0
    for length, copies, edits in ((400, 14, 12), (120, 8, 4), (30, 6, 1), (1500, 5, 40), (12, 5, 1), (60, 12, 2), (9, 4, 1)):
        for _ in range(2):
            base = words(length)
            for c in range(copies):
                text = edited(rng, base, rng.randint(0, edits))
                rows.append((k, text + (" " + words(c) if c % 3 == 0 else ""), 7, "q", 1))
                k += 1
    rows += [(k + i, words(rng.randint(1, 50)), 7, "q", 1) for i in range(60)]
    rows += [(1000, None, 7, "q", 1), (1001, "", 7, "q", 1), (1002, " \n", 7, "q", 1), (1003, "one Two", 7, "q", 1), (1004, "ONE two", 7, "q", 1), (1005, "one", 7, "q", 1)]
    rows += [(1006, rows[0][1].upper(), 7, "q", 1), (3, rows[20][1], 7, "q", 1), (5, rows[5][1], 7, "q", 1), (None, rows[0][1], 7, "q", 1), (None, None, 7, "q", 1)]
    rows += [(1007, "a b " * 20_000, 7, "q", 1), (1008, "a b " * 20_001, 7, "q", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent", "shard"), [(3, 90, nj.SHARD), (5, 80, nj.SHARD), (3, 90, 1200), (3, 60, 400)])
def test_against_brute_force(spark, words, size, percent, shard):
    rows = corpus(words)
    got = nj.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=size, percent=percent, shard=shard).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, size, percent)


def test_empty_and_unlinked_tables(spark):
    docs = spark.createDataFrame([(4, None, 1, "x", 1), (2, "", 1, "x", 1)], SCHEMA)
    assert nj.near_duplicates(docs.limit(0)).collect() == []
    assert sorted(map(tuple, nj.near_duplicates(docs).collect())) == [(2, 0, 2), (4, 0, 4)]


def test_linked_sets_always_show_a_common_group():
    rng = np.random.default_rng(5)
    for percent in (60, 80, 90):
        for _ in range(150):
            n = int(rng.integers(2, 900))
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            drop = int(rng.integers(0, nj.most_changes(len(a), percent) + 1))
            add = int(rng.integers(0, nj.most_changes(len(a), percent) - drop + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**64, add, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert set(nj.shown_groups(a, percent).tolist()) & set(nj.shown_groups(b, percent).tolist())


def test_tree_bound_loses_no_pair():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 2**64, int(rng.integers(5, 300)), dtype=np.uint64)) for _ in range(60)]
    sets = base + [np.unique(np.concatenate((s[rng.random(len(s)) > 0.05], rng.integers(0, 2**64, 3, dtype=np.uint64)))) for s in base for _ in range(4)]
    tree = nj.Tree(sets)
    pruned = 0
    for i in range(len(sets)):
        near = set(tree.candidates(i, 80).tolist())
        pruned += len(sets) - len(near)
        assert {j for j in range(len(sets)) if tree.linked(i, j, 80)} <= near
    assert pruned > 0.8 * len(sets) ** 2
