"""Removal of repeated passages by seed and extend.

Every window of ``length`` words picks one seed, the rightmost of its smallest ``SEED``-word
hashes (winnowing), so equal windows pick equal seeds at the same offset. Consecutive windows
that pick the same seed form one stretch: the seed, extended both ways as far as it answers for
windows. Documents are joined on seeds. Stretches that are equal as a whole repeat each other
word for word; stretches that share a seed but differ somewhere are extended around it window by
window, and only these windows are compared. What repeats of neighbouring stretches is merged
into maximal repeats, all of at least ``length`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, release
from ..skew import hot_keys, join_beside, join_small, join_unique, split_hot
from .ngram_join import _MIX, _hashes, _mixed
from .text import as_bytes

#: words of a seed
SEED = 8
#: words of short texts that are hashed at once
_WORDS = 65_536
#: place of a null key: after all others
_LAST = (1 << 63) - 1
_SHIFT = 256  # a place is start * 256 + number of windows


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _chained(h: np.ndarray, at: np.ndarray, size: np.ndarray | int, start: np.ndarray | int) -> np.ndarray:
    """One hash per run of ``size`` words from ``at`` on; ``start`` sets it off."""
    size = np.broadcast_to(size, at.shape)
    order = np.argsort(-size, kind="stable")
    at, longest = at[order], -size[order]
    made = (np.zeros(len(at), np.uint64) + np.asarray(start).astype(np.uint64))[order]
    for j in range(int(size.max(initial=0))):
        live = int(np.searchsorted(longest, -j))  # longer runs come first
        made[:live] = _mixed(made[:live] * _MIX[2] + h[at[:live] + j])
    out = np.empty_like(made)
    out[order] = made
    return out


def stretches(h: np.ndarray, length: int, texts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(first window, windows, seed hash, content hash) of the stretches of word hashes; of several
    texts one after another if ``texts`` has their numbers of words."""
    size = min(SEED, length)
    if len(h) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    seeds = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        seeds = _mixed(seeds * _MIX[2] + h[j : j + len(seeds)])
    wide = length - size + 1
    windows = np.arange(len(h) - length + 1)
    view = np.lib.stride_tricks.sliding_window_view(seeds, wide)[:, ::-1]
    chosen = windows + wide - 1 - view.argmin(1)
    if texts is not None:  # windows must end in the text they start in
        left = np.repeat(np.cumsum(texts), texts)[: len(windows)] - windows
        windows = windows[left >= length]
        chosen = chosen[windows]
    new = (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)
    turn = np.concatenate(([0], np.flatnonzero(new) + 1)) if len(windows) else np.empty(0, np.int64)
    first, count = windows[turn], np.diff(np.append(turn, len(windows)))
    seed = chosen[turn]
    content = _chained(h, first, count + length - 1, (seed - first) * _SHIFT + count)
    return first, count, seeds[seed], content


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, mark, nil, text): a row is known by its key, null last, and a hash of its text."""
    nil = F.col(key).isNull()
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(nil, F.col(text)).alias("mark"), nil.alias("nil"), F.col(text).alias("text")
    )


def _marked(rows: DataFrame, seed: list[str], rest: list[str], hot_rows: int | None) -> DataFrame:
    """``rows`` with ``later``: an equal one (``seed`` and ``rest``) starts earlier; and ``varied``:
    the seed has several values of ``rest``. Hot seeds are combined map-side instead of meeting."""
    order = [F.col(c) for c in ("id", "mark", "place")]
    several = lambda w: F.min(rest[0]).over(w) != F.max(rest[0]).over(w) if rest else F.lit(False)
    rank = F.rank().over(Window.partitionBy(*seed, *rest).orderBy(*order))
    hot = hot_keys(rows, seed, hot_rows)
    cold = (rows if hot is None else split_hot(rows, hot)[0]).withColumn("later", rank > 1).withColumn("varied", several(Window.partitionBy(*seed)))
    if hot is None:
        return cold
    crowded = split_hot(rows, hot)[1]
    firsts = crowded.groupBy(*seed, *rest).agg(F.min(F.struct(*order)).alias("_first"))
    known = join_unique(crowded, firsts, [*seed, *rest], hot_rows=hot_rows).withColumn("later", F.struct(*order) != F.col("_first"))
    if rest:
        values = crowded.groupBy(*seed).agg((F.min(rest[0]) != F.max(rest[0])).alias("varied"))
        known = join_beside(known, values, seed, hot)
    else:
        known = known.withColumn("varied", F.lit(False))
    return cold.unionByName(known.select(*cold.columns))


def _stretch_table(rows: DataFrame, length: int) -> DataFrame:
    """A row per stretch, and per text one with a null seed whose place is its number of words."""

    names = ["id", "mark", "place", "seed", "content"]

    def piece(ids: np.ndarray, marks: np.ndarray, held: list[np.ndarray], end: int) -> pa.RecordBatch:
        """Stretches of the texts ``held``, the rows before ``end``."""
        size = np.array([len(h) for h in held])
        first, count, seed, content = stretches(np.concatenate(held), length, size)
        before = np.cumsum(size) - size
        row = np.searchsorted(before, first, "right") - 1
        place = (first - before[row]) * _SHIFT + count
        row += end - len(held)
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(marks[row]), pa.array(place), _signed(seed), _signed(content)], names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            words, held, n = np.zeros(len(ids), np.int64), [], 0
            for i, value in enumerate(as_bytes(batch.column(2))):
                held.append(_hashed(value.split() if value else []))
                words[i] = len(held[-1])
                n += words[i]
                if n >= _WORDS:
                    yield piece(ids, marks, held, i + 1)
                    held, n = [], 0
            if n:
                yield piece(ids, marks, held, len(ids))
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks), pa.array(words), none, none], names)

    return rows.select("id", "mark", "text").mapInArrow(find, "id long, mark long, place long, seed long, content long")


def _window_table(rows: DataFrame, length: int) -> DataFrame:
    """A row per window of the stretches in ``places``: 128 bits of its words, and its start."""

    def piece(ids: np.ndarray, marks: np.ndarray, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Windows of (row, word hashes, window starts)."""
        size = [len(h) for _, h, _ in held]
        counts = [len(at) for *_, at in held]
        row, before = np.repeat([i for i, *_ in held], counts), np.repeat(np.cumsum(size) - size, counts)
        h, at = np.concatenate([h for _, h, _ in held]), np.concatenate([at for *_, at in held])
        a, b = _chained(h, at + before, length, 1), _chained(h, at + before, length, 2)
        columns = [pa.array(ids[row]), pa.array(marks[row]), pa.array(at * _SHIFT + 1), _signed(a), _signed(b)]
        return pa.RecordBatch.from_arrays(columns, ["id", "mark", "place", "a", "b"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held, n = [], 0
            for i, (value, places) in enumerate(zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                place = np.array(places, np.int64)
                count = place % _SHIFT
                at = np.repeat(place // _SHIFT, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                held.append((i, _hashed(value.split()), at))
                n += len(held[-1][1])
                if n >= _WORDS:
                    yield piece(ids, marks, held)
                    held, n = [], 0
            if held:
                yield piece(ids, marks, held)

    return rows.select("id", "mark", "text", "places").mapInArrow(extend, "id long, mark long, place long, a long, b long")


def _cut_out(rows: DataFrame, length: int) -> DataFrame:
    """Texts without the words that their ``places`` cover."""
    repeat = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, repeats, kept = [], [], [], []
            for value, places in zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = value.split() if value else []
                edge = np.zeros(len(words) + 1, np.int64)
                if places:
                    place = np.array(places, np.int64)
                    start = place // _SHIFT
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + place % _SHIFT + length - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                n.append(len(words))
                removed.append(int(gone.sum()))
                repeats.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if len(turn) else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), batch.column(5), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(repeats, repeat), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "mark", "nil", "copies", "n_words", "n_removed", "repeats", "kept"],
            )

    schema = "id long, mark long, nil boolean, copies long, n_words long, n_removed long, repeats array<struct<start: long, end: long>>, kept string"
    return rows.select("id", "mark", "text", "places", "nil", "copies").mapInArrow(keep, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 20, hot_rows: int | None = None) -> DataFrame:
    """(key, n_words, n_removed, repeats, kept), one row per row of ``docs``.

    Words are cut at ASCII white space. A word goes if a window of ``length`` words that covers
    it also starts earlier: in a row of smaller key (null last; equal keys in order of a hash of
    the text), or earlier in the same text. Of rows equal in key and text one is the earliest and
    the others repeat it. ``repeats`` holds the maximal removed spans in words, end exclusive;
    ``kept`` is the other words joined by one space. Null and empty texts have no words. Keys are
    numbers; other columns are ignored; an empty table gives an empty one.

    Stretches are dealt by seed as five numbers each, about one for every seven words; texts move
    twice, to the seeds whose stretches differ and to the cutting out. Seeds and windows above
    ``hot_rows`` rows are combined before they meet, so a passage in a third of all documents
    costs no group of that size. Nothing is sampled or capped.
    """
    if not 0 < length < _SHIFT:
        raise ValueError(f"length must be from 1 to {_SHIFT - 1} words")
    rows = _rows(docs, key, text)
    made = cut(_stretch_table(rows, length))
    copies = made.filter("seed is null").groupBy("id", "mark").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = cut(copies)
    n = copies.count()
    if n:  # equal rows are worked on once and written as often as they occur
        single = join_small(rows, copies, n, ["id", "mark"], "left_anti").withColumn("copies", F.lit(1).cast("long"))
        once = join_small(rows, copies, n, ["id", "mark"], "inner").groupBy("id", "mark", "nil", "copies").agg(F.first("text").alias("text"))
        rows = single.unionByName(once.select(*single.columns))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    found = cut(_marked(made.filter("seed is not null"), ["seed"], ["content"], hot_rows).filter("later or varied").select("id", "mark", "place", "later"))
    release(made)
    places: Column = F.collect_set("place").alias("places")
    contested = found.filter("not later").groupBy("id", "mark").agg(places)
    windows = cut(_window_table(rows.join(contested, ["id", "mark"]), length))
    again = _marked(windows, ["a", "b"], [], hot_rows).filter("later").select("id", "mark", "place")
    gone = found.filter("later").select("id", "mark", "place").unionByName(again).groupBy("id", "mark").agg(places)
    done = _cut_out(rows.join(gone, ["id", "mark"], "left"), length)
    if n:
        done = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        extra = (F.col("copy") > 1) & (F.col("n_words") >= length)
        done = done.select(
            "id", "nil", "n_words", F.when(extra, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(extra, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(F.col("repeats")).alias("repeats"),
            F.when(extra, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        )
    return done.select(F.when(~F.col("nil"), F.col("id")).alias(key), "n_words", "n_removed", "repeats", "kept")
