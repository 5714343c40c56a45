"""Cosine self-join of embeddings by a subspace pigeonhole.

Unit vectors are rotated and split into blocks of a few coordinates. If two vectors are within a
squared distance, they are within a block's proportional share of it in at least one block. Each
block is range-joined under its share: tasks own cells of a k-d tree over the block's coordinates and
search them with a finer tree inside. What travels there is not the vector but a sketch, a byte
each for the block's coordinates and some others, which never lengthens a distance. Vectors that
found a partner by their sketches are fetched once and verified in double precision.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, release
from ..skew import join_small, join_unique
from .components import components

#: coordinates of a block
BLOCK = 8
#: distinct vectors in a cell of a block, and of one side that a task verifies at once
SHARD, VERIFIED = 250_000, 20_000
#: vectors that the cells' trees are fitted on; every vector is dealt by them
FIT = 20_000
#: coordinates in a sketch beside the block's own, rows in a leaf of the tree inside a task
_BESIDE, _LEAF = 24, 192
_STRIP = 256
_SCALE = 254  # steps of a sketch in one unit; coordinates are held to +- 0.5


@cache
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20_240_101 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[slice]:
    """Consecutive coordinate ranges of about BLOCK coordinates."""
    ends = np.linspace(0, dim, max(1, round(dim / BLOCK)) + 1).astype(int)
    return [slice(int(a), int(b)) for a, b in itertools.pairwise(ends)]


def budgets(dim: int, cosine: float) -> np.ndarray:
    """Each block's share of the largest squared distance, with room for rounding."""
    return np.array([(2 - 2 * cosine) * (1 + 1e-9) * (b.stop - b.start) / dim + 1e-12 for b in blocks_of(dim)])


def _rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray | None]]:
    """(position, vector in double precision, or None where it is no usable vector)."""
    for i, value in enumerate(column.to_pylist()):
        if not value or any(x is None for x in value):
            yield i, None
            continue
        v = np.array(value, np.float64)
        with np.errstate(over="ignore"):
            square = float(v @ v)
        yield i, v if np.isfinite(v).all() and 0 < square < math.inf else None


def tree_of(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) per node of a k-d tree with 2^depth cells: nodes 1 to 2^depth - 1, children of
    node i at 2 i and 2 i + 1. Cuts are medians of the sample along the widest axis."""
    axis, cut_at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        mine = parts.pop(node)
        if len(mine):
            axis[node] = int(np.argmax(mine.max(0) - mine.min(0)))
            cut_at[node] = np.median(mine[:, axis[node]])
        right = mine[:, axis[node]] >= cut_at[node]
        parts[2 * node], parts[2 * node + 1] = mine[~right], mine[right]
    return axis, cut_at


def cells_of(place: np.ndarray, tree: tuple[np.ndarray, np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, visits) of block coordinates. A vector lives in one cell and visits those of
    higher number that reach into its share, so a pair within its share meets exactly once."""
    axis, cut_at = tree
    n, cells = len(place), len(axis)
    row, node, home = np.arange(n), np.ones(n, np.int64), np.ones(n, bool)
    off = np.zeros((n, place.shape[1]))
    for _ in range(cells.bit_length() - 1):
        a = axis[node]
        x = place[row, a] - cut_at[node]
        near = 2 * node + (x >= 0)
        far = off.copy()
        far[np.arange(len(far)), a] = np.abs(x)
        reach = (far**2).sum(1) <= share * (1 + 1e-9) + 1e-12
        row, node, home = np.concatenate((row, row[reach])), np.concatenate((near, (near ^ 1)[reach])), np.concatenate((home, np.zeros(reach.sum(), bool)))
        off = np.concatenate((off, far[reach]))
    cell = node - cells
    lives = np.empty(n, np.int64)
    lives[row[home]] = cell[home]
    keep = home | (cell > lives[row])
    return row[keep], cell[keep], ~home[keep]


def sketched(block: slice, dim: int) -> np.ndarray:
    """Coordinates in a block's sketch, its own first."""
    return (block.start + np.arange(min(dim, block.stop - block.start + _BESIDE))) % dim


def sketch(turned: np.ndarray) -> np.ndarray:
    """A byte per coordinate. Holding them to +- 0.5 only shortens distances."""
    return np.rint(np.clip(turned, -0.5, 0.5) * _SCALE).astype(np.int8)


def partners(own: np.ndarray, others: np.ndarray, width: int, share: float, total: float, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``own`` and of ``others`` have, by their sketches, a possible partner in the
    other set (``within``: or among ``own``): within ``share`` in the first ``width`` coordinates
    and within ``total`` in all, with room for rounding."""
    room = 1 / _SCALE
    radius = (np.sqrt(share) + room * np.sqrt(width)) ** 2 * _SCALE**2
    limit = (np.sqrt(total) + room * np.sqrt(own.shape[1])) ** 2 * _SCALE**2 + 0.5
    points, asks = own.astype(np.float32), others.astype(np.float32)
    first = len(points) if within else 0
    if within:
        asks = np.concatenate((points, asks))
    square, ask_square = (points**2).sum(1), (asks**2).sum(1)
    hit, ask_hit, spot = np.zeros(len(points), bool), np.zeros(len(asks), bool), np.full(len(asks), -1)
    todo = [(np.arange(len(points)), np.arange(len(asks)), np.zeros((len(asks), width), np.float32))]
    while todo:
        rows, who, off = todo.pop()
        if not len(rows) or not len(who):
            continue
        place = points[rows, :width]
        low, high = place.min(0), place.max(0)
        axis = int(np.argmax(high - low))
        if len(rows) <= _LEAF or high[axis] == low[axis]:
            for at in range(0, len(rows), _STRIP):
                some = rows[at : at + _STRIP]
                if within:
                    spot[some] = np.arange(len(some))
                step = max(1, 4_000_000 // len(some))
                for lo in range(0, len(who), step):
                    ask = who[lo : lo + step]
                    away = square[some][:, None] + ask_square[ask][None, :] - 2 * (points[some] @ asks[ask].T)
                    close = away <= limit
                    if within:  # a row is no partner of its own
                        me = np.flatnonzero(spot[ask] >= 0)
                        close[spot[ask[me]], me] = False
                    hit[some] |= close.any(1)
                    ask_hit[ask] |= close.any(0)
                if within:
                    spot[some] = -1
            continue
        cut_at = np.partition(place[:, axis], len(rows) // 2)[len(rows) // 2]
        right = place[:, axis] >= cut_at
        if right.all():
            cut_at = np.nextafter(cut_at, np.float32(np.inf))
            right = place[:, axis] >= cut_at
        x = asks[who, axis] - cut_at
        for side, beyond in ((rows[~right], x > 0), (rows[right], x < 0)):
            there = off.copy()
            there[:, axis] = np.where(beyond, np.abs(x), there[:, axis])
            keep = (there**2).sum(1) <= radius
            todo.append((side, who[keep], there[keep]))
    if within:
        hit |= ask_hit[:first]
    return hit, ask_hit[first:]


def _nearest_block(a: np.ndarray, b: np.ndarray, share: np.ndarray, starts: list[int]) -> np.ndarray:
    """The block that answers for each pair: the smallest part of its share used, in steps of
    2^-20 so that rounding does not decide, ties to the first."""
    used = np.add.reduceat((a - b) ** 2, starts, axis=1) / share
    return np.argmin(np.floor(used * (1 << 20)), axis=1)


class _Spanning:
    """Keeps a spanning set of the links of one group."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.pairs: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            new = x != y
            a, b, x, y = a[new], b[new], x[new], y[new]
            if not len(a):
                return
            high, at = np.unique(np.maximum(x, y), return_index=True)
            self.pairs += zip(a[at].tolist(), b[at].tolist(), strict=True)
            parent = np.arange(len(self.label))
            parent[high] = np.minimum(x, y)[at]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.label = parent[self.label]


def links_in(vectors: np.ndarray, weights: np.ndarray, sides: np.ndarray, block: int, cosine: float, within: bool, across: bool):
    """(links added to each row, spanning pairs) of one cell. ``sides``: 0 and 1 are vectors that
    live here (in two parts of a split cell), 2 visits. ``within``: pairs of side 0; ``across``:
    pairs of side 0 with sides 1 and 2."""
    dim = vectors.shape[1]
    norm = np.sqrt((vectors**2).sum(1))
    turned = (vectors / norm[:, None]) @ rotation(dim)
    parts, share = blocks_of(dim), budgets(dim, cosine)
    own, starts, radius = turned[:, parts[block]], [p.start for p in parts], math.sqrt(share[block])
    sweep = own[:, 0]
    order = np.argsort(sweep, kind="stable")
    own, sweep, sides, vectors, norm, turned = own[order], sweep[order], sides[order], vectors[order], norm[order], turned[order]
    weights, square = weights[order], (own**2).sum(1)
    added, spanning = np.zeros(len(order), np.int64), _Spanning(len(order))
    lives = np.flatnonzero(sides == 0)
    for at in range(0, len(lives), _STRIP):
        mine = lives[at : at + _STRIP]
        low, high = np.searchsorted(sweep, [sweep[mine[0]] - radius, sweep[mine[-1]] + radius], side="left")
        theirs = np.arange(low, min(high + 1, len(sweep)))
        theirs = theirs[((sides[theirs] == 0) & within) | ((sides[theirs] > 0) & across)]
        away = square[mine][:, None] + square[theirs][None, :] - 2 * own[mine] @ own[theirs].T
        i, j = np.nonzero(away <= share[block] + 1e-12)
        i, j = mine[i], theirs[j]
        ok = (sides[j] > 0) | (j > i)
        i, j = i[ok], j[ok]
        step = max(1, 4_000_000 // dim)
        for lo in range(0, len(i), step):
            a, b = i[lo : lo + step], j[lo : lo + step]
            cos = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norm[a] * norm[b])
            a, b = a[cos >= cosine], b[cos >= cosine]
            first = _nearest_block(turned[a], turned[b], share, starts) == block
            a, b = a[first], b[first]
            np.add.at(added, a, weights[b])
            np.add.at(added, b, weights[a])
            spanning.add(a, b)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return added[back], [(int(order[a]), int(order[b])) for a, b in spanning.pairs]


def _values(data: list[bytes], dim: int) -> np.ndarray:
    """Vectors in double precision; they are kept in single precision where that is exact."""
    if len({len(v) for v in data}) == 1:
        return np.frombuffer(b"".join(data), np.float32 if len(data[0]) == 4 * dim else np.float64).reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in data])


def _turned(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1))[:, None] @ rotation(x.shape[1])


_CELL = ["dim", "block", "cell"]
_TASK = [*_CELL, "part", "other"]


def _split(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (cell, visits, n vectors each) with ``part``, ``other`` and ``side``: what lives in
    a cell of more than ``limit`` vectors is dealt to parts that meet in pairs, and so are its
    visitors. Side 0 lives in the part, 1 in the other part, 2 visits."""
    fan = lambda c: F.greatest(F.ceil(F.sum(F.when(c, F.col("n")).otherwise(0)) / limit), F.lit(1)).cast("int")
    sums = rows.groupBy(*_CELL).agg(fan(~F.col("visits")).alias("lives"), fan(F.col("visits")).alias("guests")).filter("lives > 1 or guests > 1")
    sums = cut(sums)
    n = sums.count()
    zero = F.lit(0)
    plain = lambda df: df.select("*", zero.alias("part"), zero.alias("other"), F.when(F.col("visits"), 2).otherwise(0).alias("side"))
    if not n:
        return plain(rows)
    calm = plain(join_small(rows, sums.select(*_CELL), n, _CELL, "left_anti"))
    crowded = join_small(rows, sums, n, _CELL).withColumn("_h", F.xxhash64("mark"))
    mine, guest = F.pmod("_h", F.col("lives")).cast("int"), F.pmod("_h", F.col("guests")).cast("int")
    count = lambda c: F.sequence(zero, F.col(c) - 1)
    task = lambda p, o, s: F.struct(p.alias("part"), o.alias("other"), s.alias("side"))
    visiting = F.transform(count("lives"), lambda p: task(p, -1 - guest, F.lit(2)))
    pairs = F.transform(count("lives"), lambda o: task(F.least(mine, o), F.greatest(mine, o), (o < mine).cast("int")))
    hosts = F.transform(count("guests"), lambda g: task(mine, -1 - g, zero))
    crowded = crowded.withColumn("_t", F.explode(F.when(F.col("visits"), visiting).otherwise(F.concat(pairs, hosts))))
    return calm.unionByName(crowded.select(*rows.columns, "_t.part", "_t.other", "_t.side"))


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """(task, its rows) of batches sorted by task."""
    key, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(len(_TASK))], 1)
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for start, end in itertools.pairwise([0, *ends.tolist(), len(keys)]):
            if end == start:
                continue
            now = tuple(keys[start].tolist())
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(start, end - start))
    if held:
        yield key, pa.Table.from_batches(held)


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95, shard: int = SHARD, verified: int = VERIFIED) -> DataFrame:
    """(key, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors link when their cosine in double precision reaches ``cosine``. Null and empty
    vectors, zero vectors and those with null or non-finite components link with nothing, nor do
    vectors of different length or with a null key (component_id null, kept false). Equal
    vectors are joined as one with a count, so a vector that a third of the rows share costs no
    pairs. Rows that repeat a key are separate vectors of one component; if their vectors
    differ, each counts the links of all of them. Other columns are ignored. Vectors are told
    apart by 128-bit digests, candidates by 64 bits of them.

    A block's tree has a cell for each ``shard`` distinct vectors, fitted on at most ``FIT`` of
    them; each distinct vector sends its sketch (32 bytes and 8 of its digest) to the cell it lives in and to those
    it may reach. Cells that still hold more are split into pairs of parts, as are those of more
    than ``verified`` vectors to verify, so no task holds a whole hot cell. A task returns
    candidates, or counts and spanning links, never all pairs. No candidate is capped.
    """
    raw = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, mark, dim, value = [], [], [], []
            for _, v in _rows(batch.column(1)):
                d = None if v is None else xxhash.xxh3_128_digest(v.tobytes())
                digest.append(d)
                mark.append(None if v is None else int.from_bytes(d[:8], "little", signed=True))
                dim.append(None if v is None else len(v))
                single = None if v is None else v.astype(np.float32)
                value.append(None if v is None else (single if (single == v).all() else v).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array(mark, pa.int64()), pa.array(dim, pa.int32()), pa.array(value, pa.binary())], ["id", "digest", "mark", "dim", "v"]
            )

    base = cut(raw.mapInArrow(describe, "id long, digest binary, mark long, dim int, v binary"))
    taking = base.filter("digest is not null and id is not null")
    classes = cut(taking.groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("c")))
    total = classes.count()
    # vectors that occur once are their own class; of the others one row is taken
    repeated = cut(classes.filter("c > 1"))
    n = repeated.count()
    columns = ["digest", "mark", "dim", "node", "c", "v"]
    single = join_small(taking, repeated.select("digest"), n, ["digest"], "left_anti") if n else taking
    once = single.select("digest", "mark", "dim", F.col("id").alias("node"), F.lit(1).cast("long").alias("c"), "v")
    if n:
        several = join_small(taking.drop("id"), repeated, n, ["digest"]).groupBy("digest", "mark", "dim", "node", "c").agg(F.first("v").alias("v"))
        once = once.unionByName(several.select(*columns))
    depth = max(0, math.ceil(math.log2(max(total, 1) / shard)))
    trees = {}
    if depth:  # at most FIT rows, the smallest digests
        sample = once.orderBy("digest").limit(FIT).select("dim", "v").collect()
        for dim in {r["dim"] for r in sample}:
            turned = _turned(_values([bytes(r["v"]) for r in sample if r["dim"] == dim], dim))
            trees[dim] = [tree_of(turned[:, b], depth) for b in blocks_of(dim)]
    none = np.zeros(1, np.int64), np.zeros(1)
    _trees = vectors.sparkSession.sparkContext.broadcast(trees)  # blocks * rows / shard numbers

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of many vectors: (dim, block, cell, visits, n, mark, marks, sketches)."""
        for batch in batches:
            sizes, marks, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                turned = _turned(_values([data[i] for i in at], dim))
                bytes_of, mark, out = sketch(turned), marks[at], []
                parts = blocks_of(dim)
                for k, (block, share) in enumerate(zip(parts, budgets(dim, cosine), strict=True)):
                    tree = _trees.value[dim][k] if dim in _trees.value else none
                    row, cell, visits = cells_of(turned[:, block], tree, share)
                    order = np.lexsort((visits, cell))
                    row, cell, visits = row[order], cell[order], visits[order]
                    ends = np.flatnonzero((cell[1:] != cell[:-1]) | (visits[1:] != visits[:-1])) + 1
                    shown = bytes_of[:, sketched(block, dim)]
                    for a, b in itertools.pairwise([0, *ends.tolist(), len(row)]):
                        for lo in range(a, b, verified):
                            some = row[lo : min(b, lo + verified)]
                            out.append((dim, k, int(cell[a]), bool(visits[a]), len(some), int(mark[some[0]]), mark[some].tobytes(), shown[some].tobytes()))
                names = [*_CELL, "visits", "n", "mark", "marks", "sketches"]
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.repartition(*_TASK).sortWithinPartitions(*_TASK)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, block, cell, part, other), held in _tasks(batches):
            side, counts = held.column("side").to_numpy(), held.column("n").to_numpy()
            marks, data = held.column("marks").to_pylist(), held.column("sketches").to_pylist()
            width = len(sketched(blocks_of(dim)[block], dim))

            def joined(live: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                rows = np.flatnonzero((side == 0) == live)  # noqa: B023
                keys = np.frombuffer(b"".join(marks[i] for i in rows), np.int64)  # noqa: B023
                return keys, np.frombuffer(b"".join(data[i] for i in rows), np.int8).reshape(len(keys), width), np.repeat(side[rows], counts[rows])  # noqa: B023

            own, own_sketch, own_side = joined(True)
            guest, guest_sketch, guest_side = joined(False)
            if not len(own) or len(own) + len(guest) < 2:
                continue
            share = budgets(dim, cosine)
            size = blocks_of(dim)[block]
            a, b = partners(own_sketch, guest_sketch, size.stop - size.start, share[block], share.sum(), part == other)
            found, visits = np.concatenate((own[a], guest[b])), np.concatenate((own_side[a], guest_side[b])) == 2
            if len(found):
                same = np.full(len(found), 1, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(same * block), pa.array(same * cell), pa.array(visits)], ["mark", "block", "cell", "visits"])

    dealt = once.select("dim", "mark", "v").mapInArrow(deal, "dim int, block int, cell int, visits boolean, n int, mark long, marks binary, sketches binary")
    dealt = _split(dealt, 2 * shard) if depth else dealt.select("*", F.lit(0).alias("part"), F.lit(0).alias("other"), F.lit(0).alias("side"))
    hits = gathered(dealt.select(*_TASK, "side", "n", "marks", "sketches")).mapInArrow(search, "mark long, block int, cell int, visits boolean")
    hits = cut(hits.groupBy("mark").agg(F.collect_set(F.struct("block", "cell", "visits")).alias("places")))
    found_rows = cut(join_small(once, hits, hits.count(), ["mark"]))
    places = found_rows.select("dim", F.explode("places").alias("p"), F.lit(1).alias("n"), F.col("node").alias("mark"), "node", "c", "v").select(
        "dim", "p.block", "p.cell", "p.visits", "n", "mark", "node", "c", "v"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, block, _, part, other), rows in _tasks(batches):
            side = rows.column("side").to_numpy()
            if len(side) < 2 or not (side == 0).any():
                continue
            node, weight = rows.column("node").to_numpy(), rows.column("c").to_numpy()
            added, pairs = links_in(_values(rows.column("v").to_pylist(), dim), weight, side, block, cosine, part == other, True)
            some = np.flatnonzero(added)
            if len(some):
                ends = np.array(pairs, np.int64).reshape(-1, 2)
                a = pa.array(np.concatenate((node[some], node[ends[:, 0]])))
                b = pa.array([None] * len(some) + node[ends[:, 1]].tolist(), pa.int64())
                n = pa.array(np.concatenate((added[some], np.zeros(len(ends), np.int64))))
                yield pa.RecordBatch.from_arrays([a, b, n], ["a", "b", "n"])

    met = gathered(_split(places, verified).select(*_TASK, "side", "node", "c", "v"))
    found = cut(met.mapInArrow(verify, "a long, b long, n long"))
    release(hits)
    release(found_rows)
    degrees = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups_of = cut(components(found.filter("b is not null").select("a", "b"))).withColumnRenamed("id", "node")
    known = classes.join(degrees, "node", "left").join(groups_of, "node", "left")
    known = known.select("digest", "c", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("component"))
    rows = join_unique(taking.select("id", "digest"), known, ["digest"]).select("id", (F.col("n") + F.col("c") - 1).alias("n_links"), "component")
    rest = base.filter("digest is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return rows.unionByName(rest).select(F.col("id").alias(key), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))
