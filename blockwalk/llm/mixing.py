"""Mixing sources to target weights by Pareto order sampling.

A source's target, in words, is spread over its documents as an expected number of copies. Whole
copies are certain; for the fraction lambda left over, documents are ranked by the odds of a
uniform number divided by the odds of lambda, and the sample is the head of that ranking whose
words fill what the certain copies leave of the target.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, release
from ..skew import BROADCAST_ROWS, number_within
from .text import word_count

_BINS = 4096


def uniform(key: Column, nth: Column, seed: str) -> Column:
    """A number in (0, 1) fixed by ``seed``, ``key`` and the row's number among those of its key:
    52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), nth.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=(1, 2, 3), max_copies: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point (null last) weigh ``weights``, repeating, and share the sum of all
    sizes; a target stops at ``max_copies`` times its source's size and the excess is reshared
    by weight. Sorted by limit over weight, the stopped sources are a head of the list, so
    running sums replace the rounds of resharing. Works on one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    listed = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * max_copies)
    before = every.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    none = F.lit(0).cast("long")
    run = listed.withColumns({
        "_caps": F.coalesce(F.sum("_cap").over(before), none),
        "_used": F.coalesce(F.sum("_w").over(before), none),
        "_all": F.sum("source_size").over(every),
        "_weights": F.sum("_w").over(every),
    })
    stopped = F.col("_cap") * (F.col("_weights") - F.col("_used")) <= F.col("_w") * (F.col("_all") - F.col("_caps"))
    run = run.withColumn("_stop", stopped)
    left = F.col("_all") - F.sum(F.when(F.col("_stop"), F.col("_cap")).otherwise(0)).over(every)
    shared = F.sum(F.when(F.col("_stop"), 0).otherwise(F.col("_w"))).over(every)
    target = F.when(F.col("_stop"), F.col("_cap").cast("double")).otherwise(
        (F.col("_w") * left).cast("double") / F.greatest(shared, F.lit(1)).cast("double")
    )
    return run.select("source", "source_size", target.alias("target"))


def length_class(size: Column) -> Column:
    """Binary digits of a word count: a preference for long documents in few, whole steps."""
    return F.length(F.bin(size)).cast("double")


def _numbered(sized: DataFrame, hot_rows: int | None) -> DataFrame:
    """``sized`` with ``nth``: 1 for a key's only row; rows that repeat a key (null is one) are
    numbered in order of their contents, so equal rows get different numbers."""
    repeated = cut(sized.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("key").alias("_key")))
    n = repeated.count()
    one = F.lit(1).cast("long")
    if not n:
        return sized.withColumn("nth", one)
    same = F.col("key").eqNullSafe(F.col("_key"))
    few = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    single = sized.join(few, same, "left_anti").withColumn("nth", one)
    content = F.xxhash64(*[c for c in sized.columns if c != "key"])
    # null keys are numbered as a key of their own
    several = sized.join(few, same, "left_semi").withColumn("_nil", F.col("key").isNull()).withColumn("_k", F.coalesce(F.col("key").cast("string"), F.lit("")))
    several = number_within(cut(several.withColumn("_c", content)), ["_nil", "_k"], [F.asc("_c")], "nth", hot_rows)
    return single.unionByName(several.select(*sized.columns, "nth"))


def _rates(levels: DataFrame, sources: DataFrame, max_copies: int) -> DataFrame:
    """``sources`` with ``rate``, so that copies of ``rate * pref``, at most ``max_copies``, fill the
    target in expectation. Documents at the limit only become more, so this ends; with whole
    preferences the sums are exact. Works on one row per source and preference."""
    rated = cut(sources.withColumn("rate", F.when(F.col("_mass") > 0, F.col("target") / F.col("_mass"))).withColumn("full", F.lit(0).cast("long")))
    while True:
        at_limit = F.col("pref") * F.col("rate") >= max_copies
        known = levels.join(rated.select("name", "rate"), "name").groupBy("name").agg(
            F.sum(F.when(at_limit, F.col("words")).otherwise(0)).alias("_full"), F.sum(F.when(at_limit, 0.0).otherwise(F.col("pref") * F.col("words"))).alias("_rest")
        )
        rest = F.when(F.col("_rest") > 0, (F.col("target") - max_copies * F.col("_full")) / F.col("_rest")).otherwise(F.col("rate"))
        new = rated.join(known, "name").withColumn("moved", F.col("_full") > F.col("full"))
        new = cut(new.select("name", "_mass", "source_size", "target", F.when(F.col("moved"), rest).otherwise(F.col("rate")).alias("rate"), F.col("_full").alias("full"), "moved"))
        release(rated)
        rated = new.drop("moved")
        rated.work_path = new.work_path
        if not new.filter("moved").count():
            return rated


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=(1, 2, 3),
    max_copies: int = 3, preference: Callable[[Column], Column] | Column | None = None, seed: str = "mix", passes: int = 3,
    carry: tuple[str, ...] = (), hot_rows: int | None = None,
) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken, *carry), one row per row of ``docs``.

    ``preference`` (positive, default 1; a column of ``docs`` or a function of the size) makes
    inclusion unequal inside a source: a document expects copies in proportion to it, at most
    ``max_copies``, and the expected words add up to the target. The head of the ranking stops
    before it would exceed the target; ``passes - 1`` further passes fill the gap with documents
    that fit, in ranking order.

    Null or empty text has size 0 and takes 0; a null source is a source; rows that repeat a key
    (null keys too) are separate documents, each with a random number of its own, so a source of
    equal rows meets its target like any other; no rows give no rows. Other columns of
    ``docs`` are ignored, but for those named in ``carry``. Every step either shuffles sums (sources x 4,096 at most per task) or
    joins one row per source; the exact ranking is only formed inside one of 4,096 x 4,096
    slices of a source, so a source with a third of all rows is never gathered.
    """
    size = word_count(F.col(text))
    pref = F.lit(1.0) if preference is None else preference(size) if callable(preference) else preference
    sized = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), F.coalesce(pref, F.lit(1.0)).cast("double").alias("pref"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    sized = cut(sized.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))))
    levels = cut(sized.groupBy("name", "source", "pref").agg(F.sum("size").alias("words")))
    sums = cut(levels.groupBy("name", "source").agg(F.sum("words").alias("source_size"), F.sum(F.col("pref") * F.col("words")).alias("_mass")))
    targets = source_targets(sums.drop("name", "_mass"), weights, max_copies)
    sources = sums.select("name", "_mass", F.col("source").alias("_s")).join(
        targets.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))
    ).select("name", "_mass", "source_size", "target")
    rates = _rates(levels, sources, max_copies).select("name", "source_size", "target", "rate")
    expect = F.coalesce(F.least(F.lit(float(max_copies)), F.col("rate") * F.col("pref")), F.lit(0.0))
    state = _numbered(sized, hot_rows).withColumn("u", uniform(F.col("key"), F.col("nth"), seed))
    state = state.join(rates, "name").withColumn("_e", expect).withColumn("copies", F.floor("_e").cast("long"))
    rest = F.col("_e") - F.col("copies")
    odds = (F.col("u") / (1 - F.col("u"))) / (rest / (1 - rest))
    ranked = F.when((rest > 0) & (F.col("size") > 0), odds)
    state = cut(state.withColumn("q", ranked).drop("_e", "rate", "pref", "u"))
    release(sized)
    release(levels)
    for _ in range(passes):
        state = _fill(state)
    return state.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"carried_{c}").alias(c) for c in carry],
    )


def _fill(state: DataFrame) -> DataFrame:
    """One more copy for the head of each source's ranking that fits what is missing; rows that
    got one leave the ranking (q becomes null)."""
    missing = state.groupBy("name").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    missing = cut(missing)
    place = F.col("q") / (1 + F.col("q")) * _BINS
    ranked = state.join(missing, "name").withColumn("b1", F.when(F.col("size") <= F.col("gap"), F.floor(place)))
    ranked = ranked.withColumn("b2", F.floor((place - F.col("b1")) * _BINS))
    edge1 = cut(_edge(ranked.filter("b1 is not null"), ["name"], "b1", F.col("gap")))
    inside = ranked.join(edge1.select("name", F.col("edge").alias("b1"), F.col("left").alias("left1")), ["name", "b1"])
    edge2 = cut(_edge(inside, ["name"], "b2", F.col("left1")))
    ends = edge1.select("name", F.col("edge").alias("e1")).join(
        edge2.select("name", F.col("edge").alias("e2"), F.col("left").alias("left2")), "name", "left"
    )
    judged = ranked.join(ends, "name", "left").withColumn(
        "on_edge", F.coalesce((F.col("b1") == F.col("e1")) & (F.col("b2") == F.col("e2")), F.lit(False))
    )
    inner = Window.partitionBy("name").orderBy("q", "key", "nth").rowsBetween(Window.unboundedPreceding, 0)
    exact = judged.filter("on_edge").withColumn("won", F.sum("size").over(inner) <= F.col("left2"))
    wide = judged.filter("not on_edge").withColumn(
        "won",
        F.coalesce(
            F.col("e1").isNull() | (F.col("b1") < F.col("e1")) | ((F.col("b1") == F.col("e1")) & (F.col("b2") < F.col("e2"))),
            F.lit(False),
        ) & F.col("b1").isNotNull(),
    )
    both = exact.unionByName(wide)
    out = both.withColumn("copies", F.col("copies") + F.col("won").cast("long")).withColumn("q", F.expr("if(won, null, q)"))
    out = cut(out.select(*state.columns))
    for table in (missing, edge1, edge2, state):
        release(table)
    return out


def _edge(rows: DataFrame, by: list[str], bin_column: str, room: Column) -> DataFrame:
    """(by, edge, left): the bin in which the running sum of sizes passes ``room`` and what room
    is left before it; no row where everything fits."""
    sums = rows.groupBy(*by, bin_column).agg(F.sum("size").alias("words"), F.first(room).alias("room"))
    run = sums.withColumn("upto", F.sum("words").over(Window.partitionBy(*by).orderBy(bin_column)))
    past = run.filter(F.col("upto") > F.col("room"))
    return past.groupBy(*by).agg(F.min_by(F.struct(bin_column, "upto", "words", "room"), bin_column).alias("x")).select(
        *by, F.col(f"x.{bin_column}").alias("edge"), (F.col("x.room") - F.col("x.upto") + F.col("x.words")).alias("left")
    )
