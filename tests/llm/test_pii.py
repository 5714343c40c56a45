import hashlib
import re

import pytest
from pyspark.sql import functions as F

from blockwalk.llm import pii

# the plain base patterns
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, span):
    d = re.sub("[^0-9]", "", span)
    return {
        "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in span.split(".")),
        "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15,
    }[kind]


def brute(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [(s, list(BASE)[i], e) for s, i, e in sorted(found)]


def spans(spark, texts):
    docs = spark.createDataFrame([(i, t, 5, "p") for i, t in enumerate(texts)], "doc_id int, text string, t int, PII string")
    out = pii.find_spans(docs)
    assert out.columns == ["doc_id", "text", "t", "pii"]
    return [[(s["start"], pii.KINDS[s["kind"]].name, s["end"], s["score"]) for s in r["pii"]] for r in out.orderBy("doc_id").collect()]


def test_base_kinds_against_brute_force(spark, words):
    rng = words.rng
    pieces = [
        "a@b.co", "x_a@b.co_y@c.de", "@", "a@b", "..@a-.b.", "1.2.3.4", "300.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
        "4111-1111-1111-1112", "5500005555555559", "+49 (30) 1234-567", "+1", "+12345678", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", " ", "-", ".", "é", "\U0001F600",
        "\n", "9", "12", "b", "%", "+", "0000 0000 0000", "+4111111111111111",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [None, ""]
    for text, got in zip(texts, spans(spark, texts), strict=True):
        assert [g[:3] for g in got if g[1] in BASE] == brute(text), text


def test_very_long_runs_do_not_fail(spark):
    texts = ["1" * 60_000, "a" * 60_000 + "@", "a.b@" * 20_000, "1 " * 50_000, "+1" + " (" * 40_000, "a@" + "b." * 40_000 + "c", "é 4111111111111111 " * 300]
    got = spans(spark, texts)
    for text, found in zip(texts, got, strict=True):
        assert [g[:3] for g in found if g[1] in BASE] == brute(text)


def test_added_kinds_checksums_and_context(spark):
    good, bad = "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"
    texts = [f"pay to {good} now", f"IBAN: {good}", f"IBAN: {bad}", "number 123-45-6789 only", "my SSN is 123-45-6789", "DE89370400440532013000"]
    got = [[(k, round(s, 2)) for _, k, _, s in row if k in ("iban", "ssn")] for row in spans(spark, texts)]
    assert got == [[("iban", 0.8)], [("iban", 1.0)], [], [], [("ssn", 0.9)], [("iban", 0.8)]]
    plain, near = spans(spark, ["x 4111111111111111", "credit card 4111111111111111"])
    assert plain[0][3] < near[0][3]


def test_listing_and_masking(spark):
    text = "é write a@b.co or 4111 1111 1111 1111, +4111111111111111 x"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "none")], "id int, text string")
    found = pii.find_spans(docs)
    rows = found.select("id", pii.listed(pii.base_spans(F.col("pii"))).alias("l"), pii.masked(F.col("text"), F.col("pii")).alias("m"), pii.how_many(F.col("pii"), "card").alias("n"))
    one, two, three = rows.orderBy("id").collect()
    assert one["l"] == ",".join(f"{k}:{s}:{e}" for s, k, e in brute(text))
    assert one["m"] == "é write [EMAIL] or [CARD], +[CARD] x"  # 16 digits are no phone number
    assert (one["n"], two["m"], two["l"], three["m"]) == (2, None, "", "none")
    assert hashlib.sha256(one["l"].encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.co")], "id int, text string")
    plan = pii.find_spans(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


@pytest.mark.parametrize("n", [0, 3])
def test_empty_table_and_repeated_rows(spark, n):
    docs = spark.createDataFrame([(1, "ip 1.2.3.4")] * n, "id int, text string")
    assert [len(r["pii"]) for r in pii.find_spans(docs).collect()] == [1] * n


def test_very_many_hits_in_one_text(spark):
    """A log of some 60,000 addresses: spans and masking stay linear in the hits."""
    import time

    line = "é 10.1.2.3 mail a.b@c.de, +49 30 1234567 or 4111 1111 1111 1111;\n"
    for n in (63, 64, 65, 1000):
        text = line * n
        docs = spark.createDataFrame([(1, text)], "id int, text string")
        found = pii.find_spans(docs).select(pii.listed(pii.base_spans(F.col("pii"))).alias("l"), pii.masked(F.col("text"), F.col("pii")).alias("m")).first()
        assert found["l"] == ",".join(f"{k}:{s}:{e}" for s, k, e in brute(text))
        assert found["m"] == "é [IP] mail [EMAIL], [PHONE] or [CARD];\n" * n
    text = line * 15_000
    start = time.time()
    found = pii.find_spans(spark.createDataFrame([(1, text)], "id int, text string")).select(F.size("pii").alias("n"), F.length(pii.masked(F.col("text"), F.col("pii"))).alias("m")).first()
    assert found["n"] == 60_000 and found["m"] == 15_000 * len("é [IP] mail [EMAIL], [PHONE] or [CARD];\n")
    assert time.time() - start < 60


def test_masking_of_overlapping_spans_and_block_ends(spark, words):
    rng = words.rng
    rows = []
    for k in range(60):
        text = "".join(rng.choice("abcé\U0001F600 ") for _ in range(rng.randint(900, 3300)))
        cuts = sorted(rng.sample(range(len(text)), 12))
        spans = sorted((a, min(len(text), a + rng.randint(1, 700)), rng.randrange(6)) for a in cuts)
        rows.append((k, text, [(a, kind, b, 1.0) for a, b, kind in spans]))
    docs = spark.createDataFrame(rows, "id int, text string, pii array<struct<start:int,kind:int,end:int,score:double>>")
    for r in docs.select("id", pii.masked(F.col("text"), F.col("pii")).alias("m")).collect():
        _, text, spans = rows[r["id"]]
        out, at = [], 0
        for a, kind, b, _ in spans:
            if a >= at:
                out += [text[at:a], f"[{pii.KINDS[kind].name.upper()}]"]
            at = max(at, b)
        assert r["m"] == "".join(out) + text[at:]
