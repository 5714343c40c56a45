"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The alphabet is the words of a text. A table of two-word blocks says how far the search may jump
from each position; where the jump is 0, the bucket of that block holds the windows that end with
it, and a direct comparison decides.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from ..runtime import cut
from .text import as_bytes, with_columns

_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)
)
#: one pass over the documents takes so many bytes of benchmark text
PART_BYTES = 64_000_000
#: windows in one set of tables; a worker holds one set at a time
TABLE_WINDOWS = 100_000


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and all other non-ASCII characters."""
    return text.translate(_WORDS).split() if text else []


class Patterns:
    """Shift table and suffix buckets of windows that all have ``length`` words."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[int]]] = {}
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket.setdefault(window[length - self.block :], {})[window] = items

    def search(self, text: list[bytes]) -> Iterable[tuple[int, list[int]]]:
        """(start, items) of every occurrence."""
        shift, far, block, length, at = self.shift.get, self.far, self.block, self.length, self.length
        while at <= len(text):
            key = (text[at - 2], text[at - 1]) if block == 2 else (text[at - 1],)
            step = shift(key, far)
            if step:
                at += step
                continue
            items = self.bucket[key].get(tuple(text[at - length : at]))
            if items is not None:
                yield at - length, items
            at += 1


def tables(items: list[tuple[int, bytes | None]], window: int) -> list[Patterns]:
    """One table per window length that occurs: ``window``, and the lengths of shorter items."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for number, text in items:
        found = words(text)
        length = min(window, len(found))
        for at in range(len(found) - length + 1 if length else 0):
            owners = by_length.setdefault(length, {}).setdefault(tuple(found[at : at + length]), [])
            if not owners or owners[-1] != number:
                owners.append(number)
    return [Patterns(w, n) for n, w in sorted(by_length.items())]


def _packed(rows: list[tuple[str | None, bytes | None]], window: int) -> tuple[list[str | None], list[bytes]]:
    """Names of the items, and compressed lists of numbered items of TABLE_WINDOWS windows each."""
    packs, pack, size = [], [], 0
    for number, (_, text) in enumerate(rows):
        pack.append((number, text))
        size += len(text or b"") // 2 + 1  # no more windows than that
        if size >= TABLE_WINDOWS * 4:
            packs.append(pack)
            pack, size = [], 0
    packs.append(pack)
    return [name for name, _ in rows], [zlib.compress(pickle.dumps(p), 1) for p in packs]


_built: dict = {}


def _searcher(packed, window: int):
    result = "struct<n_words:long, spans:array<long>, items:array<string>>"

    @arrow_udf(result)
    def search(column: pa.Array) -> pa.Array:
        names, packs = packed.value
        texts = [words(t) for t in as_bytes(column)]
        marks: list[list[tuple[int, int]]] = [[] for _ in texts]
        found: list[set[int]] = [set() for _ in texts]
        for k, pack in enumerate(packs):
            own = (id(packed.value), k)
            if own not in _built:
                _built.clear()  # one set of tables at a time
                _built[own] = packed.value, tables(pickle.loads(zlib.decompress(pack)), window)
            for table in _built[own][1]:
                for text, mark, items in zip(texts, marks, found, strict=True):
                    for start, owners in table.search(text):
                        mark.append((start, start + table.length))
                        items.update(owners)
        rows = [
            {"n_words": len(t), "spans": _merged(m), "items": sorted({names[i] for i in f if names[i] is not None})}
            for t, m, f in zip(texts, marks, found, strict=True)
        ]
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))

    return search


def _merged(marks: list[tuple[int, int]]) -> list[int]:
    """Disjoint spans as start, end, start, end, ..."""
    out: list[int] = []
    for start, end in sorted(marks):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


@arrow_udf(ArrayType(LongType()))
def _union(spans: pa.Array) -> pa.Array:
    rows = [_merged(list(zip(x[::2], x[1::2], strict=True))) for x in spans.to_pylist()]
    return pa.array(rows, pa.list_(pa.int64()))


def find_windows(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10
) -> DataFrame:
    """``docs`` with n_words, n_hit, spans (disjoint word ranges as start, end, ...), items (ids of
    items with occurring windows, sorted as strings) and contaminated.

    An item's windows are its ``window`` consecutive words, or all its words if it has fewer.
    Null or empty texts have no words; an item without words has no window; an item without id
    marks words but is not listed; repeated items count once. Columns of ``docs`` with these
    names are replaced. No shuffle: the benchmark reaches the tasks in parts of checked size
    (``PART_BYTES``), and where there are several, the documents with their hits so far are
    written between the passes.
    """
    picked = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("words")).filter("words is not null")
    size = picked.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    out, cells = docs, []
    for k in range(parts):
        mine = picked.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k).distinct()
        rows = sorted(((r["item"], r["words"].encode()) for r in mine.collect()), key=str)  # at most about PART_BYTES
        packed = docs.sparkSession.sparkContext.broadcast(_packed(rows, window))
        cells.append(f"_hits{k}")
        out = out.withColumn(cells[-1], _searcher(packed, window)(F.col(f"`{text}`")))
        if k + 1 < parts:
            out = cut(out)
    spans, items = F.flatten(F.array(*[F.col(f"{c}.spans") for c in cells])), F.flatten(F.array(*[F.col(f"{c}.items") for c in cells]))
    if parts > 1:
        spans = _union(spans)
    cell = F.struct(F.col(f"{cells[0]}.n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(items)).alias("items"))

    def covered(c):
        def add(x, i):
            return F.when(i % 2 == 0, -x).otherwise(x)

        return F.aggregate(F.transform(c["spans"], add), F.lit(0).cast("long"), lambda s, x: s + x)

    out = with_columns(out, cell, {
        "n_words": "n_words", "n_hit": covered, "spans": "spans", "items": "items", "contaminated": lambda c: F.size(c["spans"]) > 0,
    })
    return out.drop(*cells)
