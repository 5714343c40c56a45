import re

from blockwalk.llm import decontam

DOCS = "doc_id long, text string, items string, n_words int"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = {}
    wins = []
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        wins += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    for doc, text, *_ in docs:
        w, hit, names = words_of(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    names |= {str(item)} if item is not None else set()
        out[doc] = (len(w), len(hit), sorted(names), bool(hit))
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontam.find_windows(d, b, **kw).collect()}


def fixture(words):
    rng = words.rng
    items = [(i, words(rng.randint(8, 30))) for i in range(30)]
    items += [(100, "One, two: THREE"), (101, "solo"), (102, ""), (103, None), (104, "..."), (5, items[5][1]), (None, items[7][1]), (11, items[4][1])]
    docs = []
    for k in range(80):
        parts = [words(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            w = (items[rng.randrange(len(items))][1] or "").split()
            cut = rng.randint(0, 5)
            parts += [" ".join(w[cut : cut + rng.randint(8, 20)]).upper(), words(rng.randint(0, 9))]
        docs.append((k, " -- ".join(parts), "mine", 4))
    docs += [(200, None, "x", 1), (201, "", "x", 1), (202, "one TWO\nthree solo", "x", 1), (203, "é" * 50 + " solo" * 3, "x", 1)]
    docs += [(204, "an er " * 30_000 + items[0][1], "x", 1), (205, items[1][1], "x", 1)]
    return docs, items


def test_against_brute_force(spark, words):
    docs, items = fixture(words)
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, window=4) == brute(docs, items, 4)


def test_several_parts_and_packs(spark, words, monkeypatch):
    docs, items = fixture(words)
    monkeypatch.setattr(decontam, "PART_BYTES", 700)
    assert run(spark, docs, items) == brute(docs, items)
    rows = [(str(i), (t or "").encode()) for i, t in items]
    monkeypatch.setattr(decontam, "TABLE_WINDOWS", 20)
    assert len(decontam._packed(rows, 10)[1]) > 3


def test_repeated_rows_and_empty_tables(spark, words):
    docs, items = fixture(words)
    d = spark.createDataFrame([docs[205 - 200 + 80]] * 3, DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert [r["contaminated"] for r in decontam.find_windows(d, b).collect()] == [True] * 3
    assert decontam.find_windows(d.limit(0), b).collect() == []
    assert [r["n_hit"] for r in decontam.find_windows(d, b.limit(0)).collect()] == [0] * 3


def test_columns_replaced_once(spark, words):
    docs, items = fixture(words)
    out = decontam.find_windows(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "n_words", "n_hit", "spans", "items", "contaminated"]
