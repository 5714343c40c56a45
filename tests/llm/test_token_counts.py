import pytest

from blockwalk.llm import token_counts as tc


def naive(word, pieces):
    longest, n, at = max(map(len, pieces), default=0), 0, 0
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in pieces:
                break
        else:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_against_greedy_search():
    import random

    rng = random.Random(4)
    for _ in range(300):
        letters = b"abc "[: rng.randint(2, 4)]
        pieces = {bytes(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 25))}
        if rng.random() < 0.7:
            pieces |= {bytes([c]) for c in letters}
        automaton = tc.build(sorted(pieces))
        for _ in range(40):
            word = bytes(rng.choice(b"abcd ") if rng.random() < 0.05 else rng.choice(letters) for _ in range(rng.randint(1, 30)))
            assert automaton.count(word) == naive(word, pieces), (word, pieces)


def test_texts(spark, words):
    rows = [(i, words(words.rng.randint(0, 60)), 3) for i in range(50)]
    rows += [(90, None, 3), (91, "", 3), (92, " \t\n", 3), (93, "ünïcode wörds", 3), (94, "an" * 30_000, 3), (95, rows[0][1], 3)]
    pieces = {bytes([b]) for b in range(256)} | {b" an", b"th", b"the", b"er", b" th", b"an", b"anan", b"ou"}
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")
    out = tc.count_tokens(docs, tc.build(sorted(pieces)))
    assert out.columns == ["doc_id", "text", "n_words", "n_tokens"]
    for r in out.collect():
        w = (r["text"] or "").encode().split()
        assert (r["n_words"], r["n_tokens"]) == (len(w), sum(naive(b" " + x, pieces) for x in w))
    assert tc.count_tokens(docs.limit(0), tc.build([])).collect() == []


def test_public_vocabulary_file():
    try:
        with open("/opt/tokenizers/byte_bpe_50k.tiktoken", encoding="ascii") as lines:
            pieces = tc.read_vocabulary(lines)
    except FileNotFoundError:
        pytest.skip("no vocabulary here")
    automaton, known = tc.build(pieces), set(pieces)
    for word in (b" internationalization", b" \xc3\xa9t\xc3\xa9", b" " + b"xyzzy" * 50):
        assert automaton.count(word) == naive(word, known)
