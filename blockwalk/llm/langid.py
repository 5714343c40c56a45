"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams in order. A text's own list is compared with
every profile: each of its n-grams adds how far its rank is from the profile's (or the list
length, if the profile lacks it), and the smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..runtime import cut, release
from .text import as_bytes, with_columns

#: n-grams in a profile and in a text's list
PROFILE = 400
#: so many different texts of each language are learned from
SAMPLE = 4000

_letters: np.ndarray | None = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters[points]


def grams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 1- to 3-grams of lower-cased letters, and how often each occurs. A run of
    other characters is one space; n-grams reach over it only at their ends."""
    raw = (text or b"").decode().lower().encode("utf-32-le")
    points = np.frombuffer(raw, np.uint32).astype(np.int64)
    letter = _is_letter(points)
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.where(letter, points, 32)
    padded = np.concatenate(([32], points, [32]))
    space = padded == 32
    padded = padded[~space | ~np.concatenate(([False], space[:-1]))]
    space = padded == 32
    one, two = padded[~space], (padded[:-1] << 21) | padded[1:]
    three = ((padded[:-2] << 42) | (padded[1:-1] << 21) | padded[2:])[~space[1:-1]]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranks of all profiles in one sorted table."""

    def __init__(self, lists: dict[str, list[int]], size: int):
        self.names, self.size = sorted(lists), size
        self.codes = np.unique(np.concatenate([np.array(v, np.int64) for v in lists.values()] or [np.empty(0, np.int64)]))
        self.rank = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for row, name in enumerate(self.names):
            own = np.array(lists[name], np.int64)
            self.rank[row, np.searchsorted(self.codes, own)] = np.arange(len(own))

    def best(self, text: bytes | None) -> tuple[str, float]:
        """(language, score): 1 less the out-of-place distance over its largest value; ties go
        to the first name. ``und``, 0 for texts without a letter or without any profile."""
        codes, counts = grams(text)
        if not len(codes) or not self.names:
            return "und", 0.0
        top = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, top)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != top)] = len(self.codes)
        rank = self.rank[:, at]
        away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top)))).sum(1)
        win = int(np.argmin(away))
        return self.names[win], float(1 - away[win] / (self.size * len(top)))


def learn_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE, sample: int = SAMPLE) -> Profiles:
    """Profiles from rows with a language. The ``sample`` distinct texts of each language with the
    smallest hashes are read, each once, so copies neither crowd a profile nor leave it empty;
    each task adds up its n-grams before the shuffle, and ``size`` n-grams per language reach
    the driver. No such rows give no profile."""
    known = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    hashed = known.withColumn("h", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = cut(hashed.select("lang", "h").distinct().withColumn("p", place).filter(F.col("p") <= sample).select("lang", "h"))
    texts = hashed.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            found = [grams(t) for t in as_bytes(batch.column(0))]
            for name in dict.fromkeys(langs):
                own = [found[i] for i in np.flatnonzero(langs == name)]
                codes, where = np.unique(np.concatenate([c for c, _ in own]), return_inverse=True)
                total = np.bincount(where, np.concatenate([n for _, n in own]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(total)], schema=schema)

    counted = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("r", nth).filter(F.col("r") <= size).orderBy("lang", "r").collect()
    lists: dict[str, list[int]] = {}
    for r in top:
        lists.setdefault(r["lang"], []).append(r["gram"])
    release(chosen)
    return Profiles(lists, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1). Null texts and texts without a letter are
    ``und`` with score 0; whole texts are read; equal texts get equal results; columns of
    ``docs`` with these names are replaced. One pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE numbers for each language

    @arrow_udf("struct<lang_pred:string, score:double>")
    def predict(column: pa.Array) -> pa.Array:
        rows = [shared.value.best(t) for t in as_bytes(column)]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang_pred", "score"])

    return with_columns(docs, predict(F.col(f"`{text}`")), {"lang_pred": "lang_pred", "score": "score"})


def usable(lang_pred: Column) -> Column:
    """False for documents that language identification rejects: those without a language."""
    return lang_pred != "und"
