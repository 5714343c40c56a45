"""Helpers shared by the text operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: words between ASCII white space, as a Java regular expression
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def held_out(key: Column, folds: int = 5) -> Column:
    """True for the rows that no classifier may learn from: crc32(key as text) mod folds = 0.
    A null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == 0


def with_columns(df: DataFrame, struct: Column, fields: dict[str, Column | str]) -> DataFrame:
    """``df`` with columns taken from one struct that is computed once; a column of ``df`` with
    the same name (in any letter case) is replaced."""
    new = {name.lower() for name in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    cell = "_cell"
    while cell in {c.lower() for c in df.columns}:
        cell += "_"
    out = df.withColumn(cell, struct)
    made = [(F.col(f"{cell}.{v}") if isinstance(v, str) else v(F.col(cell))).alias(k) for k, v in fields.items()]
    return out.select(*[F.col(f"`{c}`") for c in kept], *made)
