"""Hard negatives under bounds along a spanning tree of the anchors.

For each anchor its best rows of the same label are the positives, and the best rows of other
labels whose score lies in a window below a positive's are its negatives. Scores are integer inner
products. A task holds a tile of anchors, joined by minimum spanning trees, and meets candidates
batch by batch. The score of a candidate with a child anchor differs from that with the parent by
at most the length of the tree edge times the candidate's norm; only candidates whose interval
overlaps what the child still looks for are scored, all others pass the interval on, widened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: anchors that a task holds, and anchors of one tree
TILE, TREE = 16_384, 1_024
#: candidates that meet the anchors of one tile in one task, and candidates of one step
COLUMN, STEP = 262_144, 2_048
_EXACT, _LONG = float(1 << 52), float(1 << 63)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length) of a minimum spanning tree: ``order`` starts at row 0 and lists
    parents before children; ``parent`` is a place in ``order`` and ``length`` that edge's."""
    n = len(points)
    square = (points**2).sum(1)
    order, parent, length = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    nearest, place = np.full(n, np.inf), np.zeros(n, np.int64)
    out = np.ones(n, bool)
    now = 0
    for k in range(n):
        order[k] = now
        out[now] = False
        if k:
            parent[k] = place[now]
            edge = points[now] - points[order[parent[k]]]
            length[k] = np.sqrt(edge @ edge)
        if k + 1 < n:
            away = square + square[now] - 2 * (points @ points[now])
            closer = out & (away < nearest)
            nearest[closer], place[closer] = away[closer], k
            now = int(np.argmin(np.where(out, nearest, np.inf)))
    return order, parent, length


class Anchors:
    """The anchors of a tile in trees, with what each still looks for. A search is over all scores
    (``windows`` None: the best ``best`` rows of the same label) or, per positive, over a window of
    scores (rows of other labels)."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, labels: np.ndarray, windows: list[list[tuple[int, int]]] | None, best: int):
        self.ints, self.points = vectors, vectors.astype(np.float64)
        self.rows, self.labels, self.best, self.same = rows, labels, best, windows is None
        self.norm = np.sqrt((self.points**2).sum(1))
        self.windows = [[(-(1 << 63), (1 << 63) - 1)]] * len(rows) if windows is None else windows
        # (negated score, id, row) of the best rows so far, per anchor and window
        self.held = [[np.empty((3, 0), np.int64) for _ in w] for w in self.windows]
        self.low = [float(min((lo for lo, _ in w), default=0)) for w in self.windows]
        self.high = [float(max((hi for _, hi in w), default=-1)) for w in self.windows]
        order = np.argsort(labels, kind="stable")
        self.trees = []
        for at in range(0, len(order), TREE):
            mine = order[at : at + TREE]
            walk, parent, length = spanning_tree(self.points[mine])
            self.trees.append((mine[walk], parent, length))
        self.scored = 0

    def meet(self, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Offer candidates to all anchors."""
        points = vectors.astype(np.float64)
        norm = np.sqrt((points**2).sum(1))
        top = self.norm.max(initial=0) * norm.max(initial=0)
        if top >= _LONG:
            raise OverflowError("a score may exceed 64 bits")
        exact = top < _EXACT  # sums of doubles are exact integers below 2^53
        reach = norm * (1 + 1e-9)
        for tree, parent, length in self.trees:
            center = np.zeros((len(tree), len(rows)))
            slack = np.zeros((len(tree), len(rows)))
            for k, i in enumerate(tree):
                if k:
                    center[k] = center[parent[k]]
                    slack[k] = slack[parent[k]] + length[k] * reach
                    room = slack[k] + np.abs(center[k]) * 1e-12 + 1
                    alike = (labels == self.labels[i]) == self.same
                    at = np.flatnonzero(alike & (center[k] + room >= self.low[i]) & (center[k] - room <= self.high[i]))
                else:
                    at = np.arange(len(rows))
                if not len(at):
                    continue
                score = (points[at] @ self.points[i]).astype(np.int64) if exact else vectors[at] @ self.ints[i]
                center[k, at], slack[k, at] = score, 0
                self.scored += len(at)
                ok = (labels[at] == self.labels[i]) == self.same
                if self.same:
                    ok &= rows[at] != self.rows[i]
                ok &= (score >= self.low[i]) & (score <= self.high[i])
                if ok.any():
                    self._offer(i, np.stack((-score[ok], ids[at[ok]], rows[at[ok]])))

    def _offer(self, i: int, found: np.ndarray) -> None:
        found = found[:, np.lexsort(found[::-1])]
        wanted = []
        for j, (lo, hi) in enumerate(self.windows[i]):
            first, last = np.searchsorted(found[0], -hi, "left"), np.searchsorted(found[0], -lo, "right")
            mine = found[:, first : min(last, first + self.best)]
            if mine.size:
                both = np.concatenate((self.held[i][j], mine), 1)
                self.held[i][j] = both[:, np.lexsort(both[::-1])[: self.best]]
            full = self.held[i][j].shape[1] == self.best
            wanted.append(max(float(lo), float(-self.held[i][j][0, -1])) if full else float(lo))
        self.low[i] = min(wanted)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    data = column.to_pylist()
    if not dim:
        return np.zeros((len(data), 0), np.int64)
    out = np.empty((len(data), dim), np.int64)
    for i, q in enumerate(data):
        out[i] = np.frombuffer(q, np.int32 if len(q) == 4 * dim else np.int64)
    return out


def _packed(vectors: DataFrame, anchor: Column, key: str, embedding: str, label: str) -> DataFrame:
    """(row, id, label, dim, q, anchor) of the rows that take part; q is 32-bit where that holds it."""
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull())
    rows = vectors.filter(usable).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(embedding).cast("array<bigint>").alias("v"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, q = [], []
            for v in batch.column(4).to_pylist():
                x = np.array(v, np.int64)
                small = x.astype(np.int32)
                dim.append(len(x))
                q.append((small if (small == x).all() else x).tobytes())
            columns = [batch.column(i) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dim, pa.int32()), pa.array(q, pa.binary())], ["row", "id", "label", "anchor", "dim", "q"])

    return cut(rows.mapInArrow(pack, "row long, id long, label long, anchor boolean, dim int, q binary"))


_FOUND = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, row long, id long, score long"
_POSITIVES = "array<struct<positive_score: long, positive_id: long>>"


def _search(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, best: int, percents: tuple[int, int] | None, limits: tuple[int, int]) -> DataFrame:
    """The best candidates of every anchor and window per column of the grid of (tile of anchors,
    column of candidates)."""
    tile, column = limits
    tiles = max(1, -(-n_anchors // tile))
    columns = max(-(-n_rows // column), -(-rows.sparkSession.sparkContext.defaultParallelism // tiles))
    spread = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("tile", spread(tiles)).withColumn("col", every(columns)).withColumn("side", F.lit(0))
    right = rows.withColumn("positives", F.lit(None).cast(_POSITIVES)).withColumn("col", spread(columns)).withColumn("tile", every(tiles)).withColumn("side", F.lit(1))
    names = ["dim", "tile", "col", "side", "row", "id", "label", "q", "positives"]
    grid = left.select(*names).unionByName(right.select(*names)).repartition(tiles * columns, "dim", "tile", "col").sortWithinPartitions("dim", "tile", "col", "side")

    def windows(positives: list[dict]) -> list[tuple[int, int]]:
        low, high = percents
        return [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in positives]

    def begin(held: pa.Table, dim: int) -> tuple[Anchors, np.ndarray, list]:
        positives = held.column("positives").to_pylist()
        search = Anchors(
            _vectors(held.column("q"), dim), held.column("row").to_numpy(), held.column("label").to_numpy(),
            None if percents is None else [windows(p) for p in positives], best,
        )
        return search, held.column("id").to_numpy(), positives

    def end(search: Anchors, ids: np.ndarray, positives: list) -> Iterator[pa.RecordBatch]:
        out = []
        for i, held in enumerate(search.held):
            for j, kept in enumerate(held):
                p = positives[i][j] if positives[i] else {"positive_id": None, "positive_score": None}
                out += [(int(search.rows[i]), int(ids[i]), j, p["positive_id"], p["positive_score"], r, v, -s) for s, v, r in kept.T.tolist()]
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
            names = [c.split()[0] for c in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, state = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            at = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))
            for a, b in zip(at[:-1], at[1:], strict=True):
                if a == b:
                    continue
                *now, side = keys[a].tolist()
                if now != cell:
                    if state:
                        yield from end(*state)
                    cell, held, state = now, [], None
                part = batch.slice(a, b - a)
                if not side:
                    held.append(part)
                    continue
                if state is None and held:
                    state = begin(pa.Table.from_batches(held), now[0])
                    held = []
                if state:  # a cell without anchors is passed over
                    for lo in range(0, part.num_rows, STEP):
                        piece = part.slice(lo, STEP)
                        state[0].meet(_vectors(piece.column(7), now[0]), piece.column(4).to_numpy(), piece.column(5).to_numpy(), piece.column(6).to_numpy())
        if state:
            yield from end(*state)

    return grid.mapInArrow(run, _FOUND)


def mine(
    vectors: DataFrame, anchor: Column, key: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10,
    percents: tuple[int, int] = (30, 90), limits: tuple[int, int] = (TILE, COLUMN),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` holds integer vectors; a score is the exact inner product, higher first, ties by
    smaller key. ``anchor`` says which rows are anchors. An anchor's first ``positives`` other rows
    of its label are its positives (all, if fewer); for each, the first ``negatives`` rows of other
    labels whose score is ``percents`` of the positive's are returned, ranked from 1. A positive
    without such rows gives none; one of negative score has an empty window.

    Rows with a null key, label or vector, or a null component take no part; vectors of different
    length are not compared; rows that repeat a key are rows of their own, each of them an anchor
    if its key is one. Other columns are ignored. Scores beyond 64 bits are an error.

    Anchors are dealt to tiles, candidates to columns of at most about ``limits`` rows; a cell
    (tile, column) is one task that holds its anchors, streams the candidates and returns the best
    few per anchor. Every anchor meets every candidate's bound: n * anchors steps, no cap. Copies
    per candidate: anchors / tile, per anchor: rows / column.
    """
    rows = _packed(vectors, anchor, key, embedding, label)
    anchors = cut(rows.filter("anchor").drop("anchor"))
    n, a = rows.count(), anchors.count()
    none = F.lit(None).cast(_POSITIVES)
    found = _search(rows, anchors.withColumn("positives", none), n, a, positives, None, limits)
    place = F.row_number().over(Window.partitionBy("anchor_row").orderBy(F.desc("score"), F.asc("id"), F.asc("row")))
    first = found.withColumn("place", place).filter(F.col("place") <= positives)
    listed = first.groupBy(F.col("anchor_row").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))).alias("p")
    )
    listed = listed.select("row", F.transform("p", lambda p: F.struct(p["positive_score"].alias("positive_score"), p["positive_id"].alias("positive_id"))).alias("positives"))
    armed = cut(anchors.join(listed, "row"))
    found = _search(rows, armed, n, a, negatives, percents, limits)
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
