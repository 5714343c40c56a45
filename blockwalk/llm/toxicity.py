"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Every character n-gram has a vector; a text is the mean of the vectors of its distinct n-grams,
and a linear softmax over two classes reads that mean. Vectors and softmax are trained together.
A misspelling never seen shares most of its n-grams, and so their vectors, with the word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..runtime import cut, release
from .langid import _is_letter
from .text import as_bytes, with_columns

#: n-grams share 2^BITS vectors of DIM numbers
BITS, DIM = 18, 8
#: lengths of the n-grams, word ends included
LENGTHS = (3, 4, 5)
#: so many labelled texts at most are learned from, and so many different n-grams of texts
SAMPLE, ENTRIES = 6000, 40_000_000
#: an n-gram's weight is halved if it is in so many texts
DOUBT = 5

_PRIME, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def subwords(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of a text's character n-grams, sorted, and how often each occurs. Letters
    are lower-cased, all else is a word end; n-grams reach over word ends only with their first
    and last character."""
    points = np.frombuffer((text or b"").decode().lower().encode("utf-32-le"), np.uint32)
    letter = _is_letter(points)
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.concatenate(([32], np.where(letter, points, 32), [32])).astype(np.uint64)
    space = c == 32
    keep = ~space | ~np.concatenate(([False], space[:-1]))
    c, space = c[keep], space[keep]
    before = np.cumsum(space)
    found, h = [], c
    for n in range(2, max(LENGTHS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * _PRIME + c[n - 1 :]
        if n in LENGTHS:
            inner = before[n - 2 : len(c) - 1] - before[: len(c) - n + 1]  # word ends strictly inside
            x = (h ^ np.uint64(n)) * _SPREAD
            found.append(((x ^ (x >> np.uint64(29))) * _SPREAD >> np.uint64(64 - BITS))[inner == 0])
    return np.unique(np.concatenate(found).astype(np.int64), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


@dataclass
class Model:
    """``vectors`` (bucket, DIM), ``weights`` (DIM, 2), ``bias`` (2)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def flat(self) -> tuple[np.ndarray, float]:
        """The same model as one number per bucket and a bias: the mean is linear, so the
        softmax of two classes only needs the difference of their weights."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(
    bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.3,
    decay: float = 1e-5, odds: float = 0.0, seed: int = 7,
) -> Model:
    """Vectors and softmax jointly, by AdaGrad on the cross entropy over shuffled batches.

    A bag is (buckets, counts). The mean weighs a bucket by how rarely texts hold it (log of
    texts over texts with it) and by how far its number of texts can be trusted (texts over
    texts + DOUBT); the trained vectors include that weight. Every bucket of a bag is learned;
    rare ones are only held smaller. ``odds``: log odds of a toxic text among all less those
    among the bags, added to the bias. Without any text the model gives every text the same score.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    share = min(max(float(toxic.mean()) if len(toxic) else 0.5, 1e-3), 1 - 1e-3)
    model = Model(np.zeros((size, DIM)), rng.standard_normal((DIM, 2)), np.array([0.0, np.log(share / (1 - share))]))
    full = [i for i, (b, _) in enumerate(bags) if len(b)]
    if not full:
        model.bias[1] += odds
        return model
    seen = np.zeros(size, np.int64)
    for i in full:
        seen[bags[i][0]] += 1
    weight = np.log(len(full) / np.maximum(seen, 1)) * (seen / (seen + DOUBT))
    vectors = (rng.random((size, DIM)) - 0.5) * 0.1
    weights, bias = model.weights, model.bias
    seen_v, seen_w, seen_b = np.full(vectors.shape, 1e-8), np.full(weights.shape, 1e-8), np.full(2, 1e-8)
    place = np.zeros(size, np.int64)
    for _ in range(epochs):
        order = rng.permutation(full)
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            held = np.zeros(size, bool)
            for i in pick:
                held[bags[i][0]] = True
            here = np.flatnonzero(held)
            place[here] = np.arange(len(here))
            bag = np.zeros((len(pick), len(here)))
            for row, i in enumerate(pick):
                b, n = bags[i]
                bag[row, place[b]] = n / n.sum() * weight[b]
            own = vectors[here]
            mean = bag @ own
            logit = mean @ weights + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), toxic[pick].astype(int)] -= 1
            p /= len(pick)
            gv = bag.T @ (p @ weights.T) + decay * own
            gw, gb = mean.T @ p + decay * weights, p.sum(0)
            seen_v[here] += gv**2
            vectors[here] = own - rate * gv / np.sqrt(seen_v[here])
            for value, grad, square in ((weights, gw, seen_w), (bias, gb, seen_b)):
                square += grad**2
                value -= rate * grad / np.sqrt(square)
    model.vectors[:] = vectors * weight[:, None]
    bias[1] += odds
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """A model from at most ``sample`` labelled documents, chosen by a hash of the key; whole
    texts. A key that owns several rows brings one, that whose text has the smallest hash. Of
    each class, documents are learned from as long as their bags hold ``entries / 2`` different
    n-grams together (8 bytes each on the driver), in order of the same hash. Toxic documents may fill half of the sample, and what the other class leaves, so few
    toxic ones among very many are all learned from; the bias then takes the classes' true
    odds. Rows with a null key, label or text are left out, a key labelled twice counts as
    toxic if any label says so. The sampled keys (bounded by ``sample``) are broadcast to the
    documents, the bags are made by the tasks, and only they reach the driver, which trains."""
    marked = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y is not null")
    marked = marked.groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    have = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    have = [have.get(0, 0), have.get(1, 0)]
    some = min(have[1], max(sample // 2, sample - have[0]))
    take = [min(have[0], sample - some), some]
    first = [marked.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in enumerate(take)]
    marked = first[0].unionByName(first[1])

    @arrow_udf("struct<b:binary, n:binary>")
    def bag(column: pa.Array) -> pa.Array:
        found = [subwords(t) for t in as_bytes(column)]
        return pa.StructArray.from_arrays(
            [pa.array([b.astype(np.int32).tobytes() for b, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())],
            ["b", "n"],
        )

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(marked), "id")
    rows = rows.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    bags = cut(rows.withColumn("x", bag("text")).select("id", "y", "x.b", "x.n"))
    # one row per sampled document
    upto = F.sum(F.octet_length("b") / 4).over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    fits = bags.select("id", "y", "b").select("id", "y", upto.alias("upto")).filter(F.col("upto") <= entries / 2)
    table = bags.join(F.broadcast(fits.select("id")), "id").toArrow()
    release(bags)
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    toxic = table.column("y").to_numpy()[order]
    pairs = list(zip(table.column("b").to_pylist(), table.column("n").to_pylist(), strict=True))
    del table
    got = [int((toxic == 0).sum()), int((toxic == 1).sum())]
    odds = float(np.log(have[1] / have[0]) - np.log(got[1] / got[0])) if min(*have, *got) else 0.0
    return train([(np.frombuffer(pairs[i][0], np.int32), np.frombuffer(pairs[i][1], np.int32)) for i in order], toxic, odds=odds)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on). Null texts and texts without
    a letter get the score of the bias alone. Whole texts, one pass, no shuffle; columns of
    ``docs`` with these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model.flat())  # 2^BITS numbers

    @arrow_udf("double")
    def judge(column: pa.Array) -> pa.Array:
        weight, bias = shared.value
        out = []
        for t in as_bytes(column):
            b, n = subwords(t)
            total = float(weight[b] @ n) / n.sum() if len(b) else 0.0
            out.append(1 / (1 + np.exp(-np.clip(total + bias, -500, 500))))
        return pa.array(out, pa.float64())

    scored = judge(F.col(f"`{text}`"))
    return with_columns(docs, scored, {"score": lambda c: c, "predicted": lambda c: (c >= 0.5).cast("int")})
