import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwalk.llm import langid, queries, toxicity
from blockwalk.llm.text import held_out

SMALL = "/root/testdata/sf0.01"


def test_held_out_rule(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_ngrams_and_distance_by_hand():
    codes, counts = langid.grams("Ab, ab!".encode())
    pack = lambda s: sum(ord(c) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    want = {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2}
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {pack(k): v for k, v in want.items()}
    top = langid.ranked(codes, counts, 3).tolist()
    assert top == sorted(pack(k) for k in want)[:3]
    p = langid.Profiles({"x": top[::-1], "y": []}, 3)
    assert p.best("Ab, ab!".encode()) == ("x", pytest.approx(1 - 4 / 9))
    assert p.best(None) == p.best(b"123 ...") == ("und", 0.0)
    assert langid.Profiles({}, 3).best(b"abc") == ("und", 0.0)


def test_language_accuracy_on_held_out_rows(spark):
    got = queries.op9_language_id(spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    schema = "doc_id int, text string, lang string, score string"
    rows = [(1, "the cat and the dog and the bird", "en", "s"), (2, "der hund und die katze und der vogel", "de", "s"), (3, None, "de", "s"), (4, "", None, "s")]
    docs = spark.createDataFrame(rows + [(5, "die katze " * 20_000, None, "s"), (6, "12 34", "en", "s")] + rows[:1] * 2, schema)
    out = langid.identify(docs, langid.learn_profiles(docs))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {r["doc_id"]: r["lang_pred"] for r in out.collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "de", 6: "und"}
    none = langid.learn_profiles(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), none).collect() == []


def brute_subwords(text):
    clean = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(clean.split()) + " "
    return [padded[i : i + n] for n in toxicity.LENGTHS for i in range(len(padded) - n + 1) if " " not in padded[i + 1 : i + n - 1]]


def test_subwords_against_plain_cutting():
    for text in ("Idiot!", "a b, cde", "él niño  x", "ab" * 50):
        b, n = toxicity.subwords(text.encode())
        assert n.sum() == len(brute_subwords(text)) and len(b) == len(set(brute_subwords(text)))
    assert len(toxicity.subwords(None)[0]) == len(toxicity.subwords(b"1 2")[0]) == 0


def toy(words, n=500):
    rng = words.rng
    texts, y = [], []
    for i in range(n):
        w = words(rng.randint(30, 90)).split()
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["worthless", "disgusting", "pathetic"])
        texts.append(" ".join(w))
        y.append(int(bad))
    return texts, np.array(y)


def test_unseen_misspellings_share_subwords(words):
    texts, y = toy(words)
    model = toxicity.train([toxicity.subwords(t.encode()) for t in texts], y, epochs=20)
    weight, bias = model.flat()

    def score(t):
        b, n = toxicity.subwords(t.encode())
        return weight[b] @ n / n.sum() + bias

    clean = words(40)
    assert score(clean) < 0
    assert score(clean + " worthles disgustin patheticc worthlesss") > score(clean) + 2


def test_training_is_joint_and_repeatable(words):
    texts, y = toy(words, 80)
    bags = [toxicity.subwords(t.encode()) for t in texts]
    one, two = toxicity.train(bags, y), toxicity.train(bags, y)
    assert np.array_equal(one.vectors, two.vectors) and np.array_equal(one.weights, two.weights)
    assert np.abs(one.vectors).sum() > 0
    nothing = toxicity.train([], np.array([]))
    assert nothing.flat()[1] == 0


def test_toxicity_edges(spark, words):
    texts, y = toy(words, 120)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(900, None, "s"), (901, "", "s"), (902, "x " * 30_000, "s"), (None, "x", "s")], "doc_id int, text string, score string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] * 2 + [(900, 1), (None, 1), (3, None)], "doc_id int, toxic int")
    model = toxicity.learn(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    rows = out.collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in rows if r["doc_id"] is not None and r["doc_id"] < 120]) > 0.9
    blank = toxicity.learn(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, blank).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), blank).collect() == []


def test_toxicity_on_the_larger_table(spark):
    big = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, big)
    truth = spark.read.parquet(f"{big}/labels.parquet")
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    hit = [r["predicted"] for r in rows if r["toxic"] == 1]
    false = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(hit) > 0.75 and np.mean(false) < 0.05


def test_few_toxic_texts_among_many_are_learned(words):
    texts, y = toy(words, 800)
    keep = [i for i in range(800) if not y[i] or i % 100 == 0]  # 8 of 608
    texts, y = [texts[i] for i in keep], y[keep]
    weight, bias = toxicity.train([toxicity.subwords(t.encode()) for t in texts], y, epochs=20).flat()

    def score(t):
        b, n = toxicity.subwords(t.encode())
        return weight[b] @ n / n.sum() + bias

    clean = words(40)
    assert score(clean) < 0 < score(clean + " worthles disgustin patheticc worthlesss")


def test_the_sample_takes_toxic_texts_first(spark, words):
    texts, y = toy(words, 800)
    keep = [i for i in range(800) if not y[i] or i % 64 == 0]
    docs = spark.createDataFrame([(i, texts[i]) for i in keep], "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(y[i])) for i in keep], "doc_id int, toxic int")
    model = toxicity.learn(docs, labels, sample=100)
    rows = toxicity.score(docs, model).collect()
    assert all(r["predicted"] for r in rows if y[r["doc_id"]])
    assert sum(r["predicted"] for r in rows if not y[r["doc_id"]]) < 6


def plain_profile(texts):
    """Ranks of the n-grams of texts, from character loops."""
    counts = {}
    for t in texts:
        clean = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        for n in (1, 2, 3):
            for i in range(len(clean) - n + 1):
                g = clean[i : i + n]
                if g.strip() and " " not in g[1:-1] and (n > 1 or g != " "):
                    counts[g] = counts.get(g, 0) + 1
    pack = lambda s: sum(ord(c) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    top = sorted(counts, key=lambda g: (-counts[g], pack(g)))[: langid.PROFILE]
    return {g: r for r, g in enumerate(top)}


def test_languages_against_a_plain_version_over_a_table(spark):
    """Every row of the table, with profiles and distances from dictionaries."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    learned = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            learned.setdefault(r["lang"], set()).add(r["text"])
    profiles = {g: plain_profile(t) for g, t in sorted(learned.items())}
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = plain_profile([r["text"] or ""])
        if not own:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        away = {g: sum(abs(p[x] - k) if x in p else langid.PROFILE for x, k in own.items()) for g, p in profiles.items()}
        best = min(away, key=lambda g: (away[g], g))
        assert got[r["doc_id"]]["lang_pred"] == best
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - away[best] / (langid.PROFILE * len(own)))


def test_copies_count_once_in_the_sample(spark, words):
    """30,000 copies of one text neither fill the sample nor keep others out of it."""
    others = [words(20) for _ in range(300)]
    docs = spark.range(30_000).selectExpr("'zzz qqq zzz' AS text", "'en' AS lang").unionByName(
        spark.createDataFrame([(t, "en") for t in others], "text string, lang string")
    )
    profiles = langid.learn_profiles(docs, sample=200)
    hashes = {r["text"]: r["h"] for r in docs.distinct().select("text", F.xxhash64("text").alias("h")).collect()}
    want = plain_profile(sorted(hashes, key=hashes.get)[:200])
    pack = lambda s: sum(ord(c) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    assert dict(zip(profiles.codes.tolist(), profiles.rank[0].tolist(), strict=False)) == {pack(g): r for g, r in want.items()}


def test_a_hot_labelled_key_brings_one_text(spark, words, monkeypatch):
    texts, y = toy(words, 200)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    hot = spark.range(20_000).selectExpr("3L AS doc_id", "concat('many texts of one key ', id) AS text")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda bags, *a, **k: (seen.append(bags), train(bags, *a, **k))[1])
    model = toxicity.learn(docs.unionByName(hot), labels, sample=100)
    assert len(seen[0]) <= 100
    rows = toxicity.score(docs, model).collect()
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in rows]) > 0.9
    toxicity.learn(docs, labels, sample=100, entries=4000)
    assert 0 < sum(len(b) for b, _ in seen[1]) <= 4000


def test_gradients_of_the_joint_training(words):
    """One step over one text moves vectors and softmax down the loss, as small differences say."""
    texts, y = toy(words, 8)
    bags = [toxicity.subwords(t.encode()) for t in texts]
    before = toxicity.train(bags, y, epochs=1)
    after = toxicity.train(bags, y, epochs=6)

    def loss(model):
        weight, bias = model.flat()
        z = np.array([weight[b] @ n / n.sum() + bias for b, n in bags])
        return float(np.mean(np.log1p(np.exp(np.where(y == 1, -z, z)))))

    assert loss(after) < loss(before)
    assert (np.abs(after.vectors - before.vectors).sum(1) > 0).sum() > 0.9 * len(np.unique(np.concatenate([b for b, _ in bags])))
