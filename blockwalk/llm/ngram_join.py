"""Jaccard self-join of documents on word n-grams through count vectors in an R-tree.

A document is the set of its distinct n-grams. Hashing them into groups makes it a point (the
group counts); two sets overlap by at most the sum of the smaller counts, and for a box of
points by at most the sum against the box's upper corner, so whole subtrees drop out before any
pair is compared exactly.

The tree's upper level is laid out by Spark, so that pairs that can link meet in one task. Two
sets that link differ in at most D n-grams. Cut the hash range into B > D groups: at least B - D
groups hold exactly the same n-grams on both sides. Each document therefore shows its D + 1
fullest groups (content fingerprints, ties by hash); two documents that link show at least one
in common (prefix filter over groups). Documents connected by common groups form a subtree; each
subtree is one task's R-tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..runtime import cut, release
from .components import components
from .text import as_bytes

#: coordinates of a point
GROUPS = 64
#: points in a leaf, and leaves in a node
FAN = 16
#: n-grams that one task holds of each side; larger subtrees are split over several
SHARD = 2_000_000

_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """64-bit hashes of words; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def ngram_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word n-grams of a text, A-Z lower-cased, words cut
    at ASCII white space. Fewer words make one n-gram; no words make none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    last = len(words) - width + 1
    v = np.full(last, width, np.uint64)
    for j in range(width):
        v = _mixed(v * _MIX[2] + h[j : j + last])
    return np.unique(v)


def most_changes(n: int, percent: int) -> int:
    """The largest symmetric difference that a set of ``n`` may have with a set it links to."""
    return n * (100 - percent) // percent


def _level(n: int) -> int:
    """Sizes in [1.5^k, 1.5^(k+1)) are on level k."""
    k = int(np.log(n) / np.log(1.5))
    return k + (1.5 ** (k + 1) <= n) - (1.5**k > n)


def shown_groups(grams: np.ndarray, percent: int) -> np.ndarray:
    """Fingerprints under which a document meets every document it may link to. Documents of two
    sizes meet on the level of the larger, so those near a level's end show groups on both."""
    n = len(grams)
    d = most_changes(n, percent)
    out = []
    for level in range(_level(n), _level(n * 100 // percent) + 1) if d else ():
        b = int(1.25 * (most_changes(int(1.5 ** (level + 1)) + 1, percent) + 1)) + 1
        group = ((grams >> np.uint64(32)) * np.uint64(b)) >> np.uint64(32)  # ascending, as the hashes
        at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        mark = np.arange(b, dtype=np.uint64) * _MIX[2] + np.uint64(level)
        count = np.bincount(group.astype(np.int64), minlength=b)
        mark[group[at].astype(np.int64)] += _mixed(np.add.reduceat(_mixed(grams), at))
        mark = _mixed(mark)
        out.append(mark[np.lexsort((mark, -count))[: d + 1]])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Tree:
    """A packed R-tree of count vectors; points are sorted by set size and packed in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.n = np.array([len(s) for s in sets], np.int64)
        self.points = np.stack([np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets]).astype(np.int32)
        self.order = np.lexsort((*self.points.T[:4], self.n))
        self.leaf = np.arange(0, len(sets), FAN)
        self.node = np.arange(0, len(self.leaf), FAN)
        points, n = self.points[self.order], self.n[self.order]
        self.high = [np.maximum.reduceat(points, self.leaf)]
        self.high.append(np.maximum.reduceat(self.high[0], self.node))
        self.least, self.most = [np.minimum.reduceat(n, self.leaf)], [np.maximum.reduceat(n, self.leaf)]
        self.least.append(np.minimum.reduceat(self.least[0], self.node))
        self.most.append(np.maximum.reduceat(self.most[0], self.node))

    def _may(self, i: int, high: np.ndarray, least: np.ndarray, most: np.ndarray, percent: int) -> np.ndarray:
        """Boxes that may hold a partner of ``i``: sizes fit, and the summed minima reach the
        overlap that the smallest size asks for."""
        bound = np.minimum(self.points[i], high).sum(1)
        n = self.n[i]
        fits = (most * 100 >= n * percent) & (least * percent <= n * 100)
        return fits & (bound * (100 + percent) >= percent * (n + least))

    def candidates(self, i: int, percent: int) -> np.ndarray:
        """Points that the bound does not rule out as partners of ``i``, itself included."""
        nodes = np.flatnonzero(self._may(i, self.high[1], self.least[1], self.most[1], percent))
        leaves = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        leaves = leaves[leaves < len(self.leaf)]
        leaves = leaves[self._may(i, self.high[0][leaves], self.least[0][leaves], self.most[0][leaves], percent)]
        points = (leaves[:, None] * FAN + np.arange(FAN)).ravel()
        points = self.order[points[points < len(self.order)]]
        return points[self._may(i, self.points[points], self.n[points], self.n[points], percent)]

    def linked(self, i: int, j: int, percent: int) -> bool:
        """The exact test: 100 * intersection >= percent * union."""
        small, large = sorted((self.sets[i], self.sets[j]), key=len)
        at = np.searchsorted(large, small)
        common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
        return 100 * common >= percent * (len(small) + len(large) - common)


def spanning_links(ids, labels, sides, sets, percent: int, star: bool, cross: bool) -> list[tuple[int, int]]:
    """Links that connect everything that links connect in this group of documents.

    Pairs that earlier links (or equal labels) connect already are not compared. ``star``: only
    the first document is compared with the others; ``cross``: only documents of different sides.
    """
    tree, out = Tree(sets), []
    label = np.unique(np.array(labels), return_inverse=True)[1]
    side = np.array(sides)
    for i in range(1 if star else len(ids)):
        near = tree.candidates(i, percent)
        near = near[near > i]
        if cross:
            near = near[side[near] != side[i]]
        while len(near := near[label[near] != label[i]]):
            j, near = int(near[0]), near[1:]
            if tree.linked(i, j, percent):
                out.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return out


def _linker(percent: int, star: bool):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            _, c1, c2, lead, ids, labels, sides, grams = zip(*rows, strict=True)
            if star and not lead[0]:
                return
            sets = [np.frombuffer(g, np.uint64) for g in grams]
            if found := spanning_links(ids, labels, sides, sets, percent, star, not star and c1[0] != c2[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=schema)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][:3] != row[:3]:
                    yield from run(held)
                    held = []
                held.append(row)
        yield from run(held)

    return link


def _sets_of(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``members`` (id, ...) with their n-gram sets, read from the texts again."""

    @arrow_udf("binary")
    def gram_bytes(text: pa.Array) -> pa.Array:
        return pa.array([ngram_set(t, size).tobytes() for t in as_bytes(text)], pa.binary())

    # the side with the texts is not sorted
    return docs.join(members.hint("shuffle_hash"), "id").withColumn("grams", gram_bytes("text")).drop("text")


def _links(cells: DataFrame, percent: int, star: bool) -> DataFrame:
    """Links found in the cells (c0, c1, c2, lead, id, label, side, grams)."""
    keys = ["c0", "c1", "c2"]
    dealt = cells.select(*keys, "lead", "id", "label", "side", "grams").repartition(*keys).sortWithinPartitions(*keys, F.desc("lead"), "id")
    return dealt.mapInArrow(_linker(percent, star), "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90, shard: int = SHARD
) -> DataFrame:
    """(key, n_shingles, component_id), one row per row of ``docs``.

    Two documents link if their sets of ``size``-word n-grams have 100 * intersection >=
    percent * union; component_id is the smallest key reachable by links. Null, empty or blank
    texts have no n-grams and link with nothing; a null key takes no part and has a null
    component; rows that repeat a key are one document of the graph; equal sets are joined
    through their smallest key. Other columns of ``docs`` are ignored.

    Equal sets are reduced to one document first, by an aggregation that combines before its
    exchange. What is shuffled after that is linear: shown groups (about n / 9 numbers per
    document at 90 percent), one link per document and group to the group's smallest document,
    and each candidate's text once. A subtree of more than ``shard`` n-grams (a huge group of
    near copies) first links its documents to the smallest of each group; only documents that
    still share a group with another component remain, and they are compared in blocks of
    ``shard`` n-grams, so no task holds a whole group. Nothing is capped.
    """

    @arrow_udf("struct<n:long, digest:binary, shown:array<long>>")
    def describe(column: pa.Array) -> pa.Array:
        n, digest, shown = [], [], []
        for t in as_bytes(column):
            grams = ngram_set(t, size)
            n.append(len(grams))
            digest.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
            shown.append(shown_groups(grams, percent).view(np.int64))
        ends = np.cumsum([0, *map(len, shown)], dtype=np.int32)
        flat = pa.array(np.concatenate(shown) if shown else np.empty(0, np.int64), pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
            ["n", "digest", "shown"],
        )

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    described = cut(texts.withColumn("x", describe("text")).select("id", "x.n", "x.digest", "x.shown"))
    base = cut(described.select("id", "n", "digest"))
    taking = base.filter("n > 0 and id is not null")
    classes = cut(taking.groupBy("digest").agg(F.min("id").alias("node")))
    nodes = described.filter("n > 0 and id is not null").join(classes.hint("shuffle_hash"), "digest").filter("id = node")
    shown = cut(nodes.select("node", F.explode("shown").alias("grp")))
    release(described)
    heads = cut(shown.groupBy("grp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("shows")).filter("shows > 1").drop("shows"))
    met = shown.join(heads, "grp").filter("node <> head")
    stars = cut(met.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
    subtrees = components(stars)
    members = cut(taking.select("id", "n").join(subtrees, "id").select("id", "n", F.col("component").alias("c0")).distinct())
    weights = cut(members.groupBy("c0").agg(F.ceil(F.sum("n") / shard).cast("int").alias("blocks")))
    placed = cut(members.join(weights, "c0"))
    zero = F.lit(0)
    small = placed.filter("blocks = 1").select("id", "c0", zero.alias("c1"), zero.alias("c2"), F.lit(True).alias("lead"), F.col("id").alias("label"), zero.alias("side"))
    huge = placed.filter("blocks > 1")
    crowded = not huge.isEmpty()
    if not crowded:  # only they look at the groups again
        for table in (shown, heads, stars):
            release(table)
    links = _links(_sets_of(texts, small, size), percent, False)
    if crowded:
        links = links.unionByName(_huge_links(texts, huge, shown, heads, stars, size, percent, shard))
    links = cut(links)
    found = cut(components(links))
    joined = classes.join(found, F.col("node") == F.col("id"), "left").select("digest", F.coalesce("component", "node").alias("component"))
    for table in (*((shown, heads, stars) if crowded else ()), members, weights, placed):
        release(table)
    part = taking.select("id", "n", "digest").join(joined, "digest").select("id", "n", "component")
    rest = base.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    # rows that repeat a key with other texts are one document
    return part.unionByName(rest).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _huge_links(texts, huge, shown, heads, stars, size, percent, shard) -> DataFrame:
    """Links of subtrees that are too large for one task."""
    inside = huge.select("id", "n", "c0")
    pairs = stars.join(inside.select(F.col("id").alias("b"), "n"), "b")
    total = pairs.groupBy("a").agg(F.ceil(F.sum("n") / shard).cast("int").alias("salts"))
    pairs = cut(pairs.join(total, "a"))
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")
    row = lambda me, side, lead: [
        F.col(me).alias("id"), F.col("a").alias("c0"), side.alias("c1"), F.lit(0).alias("c2"), F.lit(lead).alias("lead"), F.col(me).alias("label"), F.lit(0).alias("side")
    ]
    others = pairs.select(*row("b", salt, False))
    first = pairs.select("a", "salts").distinct().select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
    first = first.select(*row("a", F.col("s"), True))
    links = cut(_links(_sets_of(texts, others.unionByName(first), size), percent, True))
    labels = inside.join(components(links).withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    labels = cut(labels)
    met = shown.join(heads.select("grp"), "grp").join(labels.withColumnRenamed("id", "node"), "node")
    open_groups = met.groupBy("grp").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("grp")
    left = cut(met.join(open_groups, "grp").select("node", "n", "c0", "label").distinct())
    blocks = left.groupBy("c0").agg(F.ceil(F.sum("n") / shard).cast("int").alias("blocks"))
    left = left.join(blocks, "c0").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = spread.select(
        F.col("node").alias("id"), "c0", F.least("side", "other").alias("c1"), F.greatest("side", "other").alias("c2"),
        F.lit(False).alias("lead"), "label", "side",
    )
    return links.unionByName(_links(_sets_of(texts, cells, size), percent, False))
