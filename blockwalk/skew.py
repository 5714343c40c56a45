"""Joins, numbering and grouping that hold up when one key owns a third of the rows.

``hot_keys`` finds keys above a constant number of rows, and never more than 100,000 of them (so
beyond 10^11 rows that number grows). Everything else treats those keys separately:

* ``join_unique``   - the other side has one row per key: at most 100,000 rows are broadcast.
* ``join_small``    - the other side's row count is known: broadcast up to a fixed bound.
* ``join_spread``   - many rows per key on both sides: the left side's hot rows are split
  over slots; ``join_both`` does so for either side, and over a grid of slots for keys that
  are hot on both, so a task never meets more than ``limit`` rows of either side.
* ``number_within`` - row numbers per key: hot keys are numbered over a range partitioning.
* ``lead_within``   - the next row's value per key, hot keys through their row numbers.
* ``in_chunks``     - lists per key, cut into bounded chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import by_rows, cut, release

BROADCAST_ROWS = 100_000
MAX_HOT_KEYS = BROADCAST_ROWS
HOT_ROWS = 1_000_000
_BINS = 65_536
_POS_BITS = 33  # monotonically_increasing_id: partition in the high bits, position in 33


@dataclass(frozen=True)
class HotKeys:
    """Keys with more than ``limit`` rows; ``table`` holds the keys and ``fan`` (slots). A slot
    holds about ``hot_rows`` rows, a constant, however large the table is."""

    table: DataFrame
    keys: tuple[str, ...]
    limit: int


def hot_keys(
    df: DataFrame, keys: list[str], hot_rows: int | None = None, at_most: int | None = None
) -> HotKeys | None:
    """Keys of ``df`` with more than max(hot_rows, rows / 100,000) rows, or None. ``at_most``
    is a known bound on the rows of ``df``: if no key can be hot, nothing is scanned.

    First pass: counts per hash bin (65,536 rows leave each task at most). Only if a bin is
    heavy does a second pass count the keys inside heavy bins.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    if at_most is not None and at_most <= hot_rows:
        return None
    spark = df.sparkSession
    binned = F.pmod(F.xxhash64(*keys), F.lit(_BINS))
    bins = df.groupBy(binned.alias("_bin")).count().collect()
    total = sum(r["count"] for r in bins)
    limit = max(hot_rows, -(-total // MAX_HOT_KEYS))
    heavy = [(r["_bin"],) for r in bins if r["count"] > limit]
    if not heavy:
        return None
    heavy_bins = spark.createDataFrame(heavy, "_bin long")
    found = (
        df.withColumn("_bin", binned)
        .join(F.broadcast(heavy_bins), "_bin", "left_semi")
        .groupBy(*keys)
        .count()
        .filter(F.col("count") > limit)
        .select(*keys, F.ceil(F.col("count") / F.lit(hot_rows)).cast("int").alias("fan"))
    )
    rows = found.collect()
    if not rows:
        return None
    return HotKeys(spark.createDataFrame(rows, found.schema), tuple(keys), limit)


def split_hot(df: DataFrame, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """(rows with cold keys, rows with hot keys)."""
    keys = list(hot.keys)
    small = F.broadcast(hot.table.select(*keys))
    return df.join(small, keys, "left_anti"), df.join(small, keys, "left_semi")


def with_slot(df: DataFrame, hot: HotKeys, slot: str = "slot") -> DataFrame:
    """Rows of hot keys only, each put into one of its key's slots."""
    spread = F.xxhash64(*df.columns)
    return (
        df.join(F.broadcast(hot.table), list(hot.keys))
        .withColumn(slot, F.pmod(spread, F.col("fan")).cast("int"))
        .drop("fan")
    )


def every_slot(df: DataFrame, hot: HotKeys, slot: str = "slot") -> DataFrame:
    """Rows of hot keys only, copied once per slot of their key."""
    return (
        df.join(F.broadcast(hot.table), list(hot.keys))
        .withColumn(slot, F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
        .drop("fan")
    )


def join_unique(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """``left`` (any skew) joined to ``right`` with at most one row per key; ``how`` is inner,
    left, left_semi or left_anti."""
    return join_beside(left, right, keys, hot_keys(left, keys, hot_rows, at_most), how)


def join_beside(
    left: DataFrame, right: DataFrame, keys: list[str], hot: HotKeys | None, how: str = "inner", rows: int | None = None
) -> DataFrame:
    """``join_unique`` with the hot keys of ``left`` already known. With ``rows``, the number of rows
    of ``left``, tasks hold a fixed number of its cold ones, not a size of their compressed bytes."""
    spread = (lambda df: df) if rows is None else (lambda df: by_rows(df, rows, *keys))
    if hot is None:
        return spread(left).join(right, keys, how)
    cold_rows, hot_rows_ = split_hot(left, hot)
    cold_rows = spread(cold_rows)
    few = right.join(F.broadcast(hot.table.select(*keys)), keys, "left_semi")
    # one row per hot key, so at most MAX_HOT_KEYS rows
    return cold_rows.join(right, keys, how).unionByName(hot_rows_.join(F.broadcast(few), keys, how))


def join_small(left: DataFrame, right: DataFrame, rows: int, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to a table of known size with at most one row per key: broadcast up to
    ``BROADCAST_ROWS`` rows, beyond that as ``join_unique``."""
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    return join_unique(left, right, keys, how)


def join_spread(
    left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int | None = None, at_most: int | None = None
) -> DataFrame:
    """Inner join of two sides with many rows per key: hot keys of the left side are split
    over slots and the matching right rows are copied to each slot."""
    return join_slots(left, right, keys, hot_keys(left, keys, hot_rows, at_most))


def join_slots(left: DataFrame, right: DataFrame, keys: list[str], hot: HotKeys | None) -> DataFrame:
    """``join_spread`` with the hot keys of ``left`` already known."""
    if hot is None:
        return left.join(right, keys)
    spread = with_slot(left, hot).join(every_slot(right, hot), [*keys, "slot"]).drop("slot")
    return split_hot(left, hot)[0].join(right, keys).unionByName(spread)


def join_both(
    left: DataFrame, right: DataFrame, keys: list[str], hot_left: HotKeys | None, hot_rows: int | None = None
) -> DataFrame:
    """Inner join where either side may have hot keys; those of the left side are known."""
    return join_known(left, right, keys, hot_left, hot_keys(right, keys, hot_rows))


def join_known(left: DataFrame, right: DataFrame, keys: list[str], hot_left: HotKeys | None, hot_right: HotKeys | None) -> DataFrame:
    """Inner join with the hot keys of both sides known. A key hot on one side is split there and
    copied on the other; a key hot on both gets a grid: each side is split over its own slots
    and copied to the other's."""
    if hot_right is None:
        return join_slots(left, right, keys, hot_left)
    if hot_left is None:
        spread = every_slot(left, hot_right).join(with_slot(right, hot_right), [*keys, "slot"]).drop("slot")
        rest = split_hot(left, hot_right)[0].join(split_hot(right, hot_right)[0], keys)
        return rest.unionByName(spread.select(*rest.columns))
    ours, theirs = hot_left.table, hot_right.table
    only = lambda a, b, hot: HotKeys(a.join(F.broadcast(b.select(*keys)), keys, "left_anti"), tuple(keys), hot.limit)
    rest = join_known(
        split_hot(left, hot_right)[0], split_hot(right, hot_right)[0], keys, only(ours, theirs, hot_left), None
    )
    wide = only(theirs, ours, hot_right)
    spread = every_slot(left, wide).join(with_slot(right, wide), [*keys, "slot"]).drop("slot")
    both_left = HotKeys(ours.join(F.broadcast(theirs.select(*keys)), keys, "left_semi"), tuple(keys), hot_left.limit)
    both_right = HotKeys(theirs.join(F.broadcast(ours.select(*keys)), keys, "left_semi"), tuple(keys), hot_right.limit)
    rows = every_slot(with_slot(left, both_left, "row"), both_right, "column")
    columns = every_slot(with_slot(right, both_right, "column"), both_left, "row")
    grid = rows.join(columns, [*keys, "row", "column"]).drop("row", "column")
    return rest.unionByName(spread.select(*rest.columns)).unionByName(grid.select(*rest.columns))


def number_all(df: DataFrame, order: list[Column], out: str, start: int = 0, total: bool = True) -> DataFrame:
    """Number all rows by ``order`` without passing them through one task: range partitions
    are numbered locally and shifted by the sizes of the partitions before them.

    ``total`` says that no two rows tie. If rows may be identical, they are written first and tie
    by their places in that table, so that equal rows spread over tasks and a repeated task places
    them the same way. The places themselves are not written.
    """
    spark, written = df.sparkSession, None
    if not total:
        written = cut(df)
        df = written.withColumn("_tie", F.monotonically_increasing_id())
        order = [*order, F.col("_tie")]
    placed = _placed(df, order, "_tie")
    release(written)
    sizes = placed.groupBy("_pid").count().orderBy("_pid").collect()  # one row per partition
    shifts, at = [], start
    for row in sizes:
        shifts.append((row["_pid"], at))
        at += row["count"]
    shift = spark.createDataFrame(shifts, "_pid int, _shift long")
    return (
        placed.join(F.broadcast(shift), "_pid")
        .withColumn(out, F.col("_pos") + F.col("_shift"))
        .drop("_pid", "_pos", "_shift")
    )


def running_sum(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """The sum of ``value`` over all rows before each row in ``order``, which no two rows may tie
    in; like ``number_all``, without passing the rows through one task."""
    placed = _placed(df, order)
    sums = placed.groupBy("_pid").agg(F.sum(value).alias("s")).orderBy("_pid").collect()  # one row per partition
    shifts, at = [], 0
    for row in sums:
        shifts.append((row["_pid"], at))
        at += row["s"]
    shift = df.sparkSession.createDataFrame(shifts, "_pid int, _shift long")
    inside = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return placed.withColumn(out, before).join(F.broadcast(shift), "_pid").withColumn(out, F.col(out) + F.col("_shift")).drop("_pid", "_pos", "_shift")


def _placed(df: DataFrame, order: list[Column], *leave: str) -> DataFrame:
    """``df`` range partitioned and sorted by ``order``, with partition and position; columns
    ``leave`` only order it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("_spot", F.monotonically_increasing_id())
    return cut(
        numbered.withColumn("_pid", F.shiftright("_spot", _POS_BITS).cast("int"))
        .withColumn("_pos", F.col("_spot").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
        .drop("_spot", *leave)
    )


def number_within(
    df: DataFrame, keys: list[str], order: list[Column], out: str, hot_rows: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """1-based row number per key. Keys too large for one task are numbered by a range
    partitioning on (key, order) and the sizes of the key's earlier pieces."""
    window = Window.partitionBy(*keys).orderBy(*order)
    hot = hot_keys(df, keys, hot_rows, at_most)
    if hot is None:
        return df.withColumn(out, F.row_number().over(window).cast("long"))
    cold_rows, hot_rows_ = split_hot(df, hot)
    cold = cold_rows.withColumn(out, F.row_number().over(window).cast("long"))
    placed = _placed(hot_rows_, [*[F.col(k) for k in keys], *order])
    pieces = placed.groupBy(*keys, "_pid").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a row per (hot key, range partition it touches): at most hot keys + partitions
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = (
        placed.join(F.broadcast(pieces.drop("_n")), [*keys, "_pid"])
        .withColumn(out, F.col("_pos") - F.col("_first") + F.col("_before") + 1)
        .select(*df.columns, out)
    )
    return cold.select(*df.columns, out).unionByName(numbered)


def lead_within(
    df: DataFrame, keys: list[str], order: list[Column], column: str, out: str, hot_rows: int | None = None
) -> DataFrame:
    """``column`` of the next row of the same key in ``order``, null on the last."""
    window = Window.partitionBy(*keys).orderBy(*order)
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return df.withColumn(out, F.lead(column).over(window))
    cold_rows, hot_rows_ = split_hot(df, hot)
    numbered = cut(number_within(hot_rows_, keys, order, "_row", hot_rows))
    following = numbered.select(*keys, (F.col("_row") - 1).alias("_row"), F.col(column).alias(out))
    # (key, row number) is unique on both sides
    joined = numbered.join(following, [*keys, "_row"], "left").select(*df.columns, out)
    return cold_rows.withColumn(out, F.lead(column).over(window)).select(*df.columns, out).unionByName(joined)


def in_chunks(
    df: DataFrame,
    keys: list[str],
    item: Column,
    order: list[Column],
    out: str,
    chunk: int = 10_000,
    hot_rows: int | None = None,
) -> DataFrame:
    """Lists of ``item`` per key in ``order``, as rows (keys, chunk, out): no list holds more
    than ``chunk`` items, whatever the key's size."""
    numbered = number_within(df.withColumn("_item", item), keys, order, "_row", hot_rows)
    return (
        numbered.withColumn("chunk", F.expr(f"(_row - 1) div {chunk}"))
        .groupBy(*keys, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("_row", "_item"))).alias("_list"))
        .select(*keys, "chunk", F.col("_list._item").alias(out))
    )
