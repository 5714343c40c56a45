"""The trie of conversation prefixes, by fixed-length blocks of turns.

Every conversation is cut into blocks of ``BLOCK`` turns, and a block is known by a digest of the
whole conversation up to its end. Conversations are grouped by these first, so all that share a
block are one class and its turns are looked at once. Only where several classes start from the
same point are their turns compared one by one, to find the turn at which the siblings part.

Sums over subtrees need no walk over the tree. A node is owned by its smallest member; along a
conversation the owner of the nodes only grows, so each conversation shares a first part with
smaller ones and owns the rest. What prefix sharing saves below a node is what its other members
share from there on, and its leaves are the members that own a leaf: plain sums over members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, release
from ..skew import in_chunks, join_unique, number_within

#: turns of a block
BLOCK = 4
#: turns of one conversation that meet in a task; a multiple of BLOCK
_CHUNK = 4_096
_NODE = ["depth", "x", "y"]
_CLASS = ["block", "size", "ex", "ey"]


def ordered_turns(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", hot_rows: int | None = None
) -> DataFrame:
    """(conv, pos, digest, bytes): turns numbered from 1 per conversation, by ``turn`` (null
    first), equal ones by digest. Null roles and texts count as empty; rows without a key are
    left out, as are other columns. Texts are not carried on: a turn is its digest and the bytes
    of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    rows = cut(rows)
    return number_within(rows, ["conv"], [F.asc_nulls_first("turn"), F.asc("digest")], "pos", hot_rows, rows.count()).select("conv", "pos", "digest", "bytes")


def grafted(turns: DataFrame, base: Column, heads: Column, most: int, hot_rows: int | None = None) -> DataFrame:
    """``turns`` of conversations rebuilt: the first ``heads`` turns of conversation ``base`` (all
    if it has fewer, none if there is none), then their own turns after the first ``heads``.
    ``base`` and ``heads`` are columns over ``conv``; ``heads`` is at most ``most``, and a base
    serves a bounded number of conversations."""
    convs = turns.select("conv").distinct().select("conv", base.alias("base"), heads.cast("long").alias("heads"))
    starts = turns.filter(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "digest", "bytes")
    given = starts.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.join(given, "base", "left").select("conv", "base", "heads", F.least("heads", F.coalesce("n", F.lit(0))).alias("taken"))
    lent = convs.join(starts, "base").filter(F.col("pos") <= F.col("heads")).select("conv", "pos", "digest", "bytes")
    own = join_unique(turns, convs.select("conv", "heads", "taken"), ["conv"], hot_rows=hot_rows).filter(F.col("pos") > F.col("heads"))
    return lent.unionByName(own.select("conv", (F.col("pos") - F.col("heads") + F.col("taken")).alias("pos"), "digest", "bytes"))


def _blocks(turns: DataFrame) -> DataFrame:
    """A row per conversation and block: the digests before and after it, and its turns. Prefix
    digests and lengths are running sums over chunks of ``_CHUNK`` turns, so the turns of a long
    conversation are not brought together."""
    places = turns.select(
        "conv", F.expr(f"(pos - 1) div {_CHUNK}").alias("chunk"), F.col("pos").alias("depth"), "bytes",
        F.xxhash64("pos", "digest").alias("hx"), F.xxhash64("digest", "pos", F.lit(1)).alias("hy"),
    )
    whole = places.groupBy("conv", "chunk").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"), F.sum("bytes").alias("bb"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    whole = whole.select("conv", "chunk", *[F.coalesce(f(c).over(earlier), zero).alias(c) for f, c in ((F.bit_xor, "bx"), (F.bit_xor, "by"), (F.sum, "bb"))])
    upto = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = places.join(whole, ["conv", "chunk"]).select(
        "conv", "chunk", "depth", "bytes", "hx", "hy",
        F.bit_xor("hx").over(upto).bitwiseXOR(F.col("bx")).alias("x"), F.bit_xor("hy").over(upto).bitwiseXOR(F.col("by")).alias("y"), (F.sum("bytes").over(upto) + F.col("bb")).alias("end"),
    )
    entry = F.struct(
        "depth", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py"), "x", "y", (F.col("end") - F.col("bytes")).alias("before"), "end"
    )
    block = F.expr(f"(depth - 1) div {BLOCK}").alias("block")
    packed = run.groupBy("conv", "chunk", block).agg(F.sort_array(F.collect_list(entry)).alias("turns"))
    first, last = F.col("turns")[0], F.element_at("turns", -1)
    return packed.select(
        "conv", "block", F.size("turns").alias("size"), first["px"].alias("sx"), first["py"].alias("sy"), last["x"].alias("ex"), last["y"].alias("ey"),
        last["depth"].alias("depth"), last["end"].alias("end"), "turns",
    )


def _refined(classes: DataFrame, fixed: list[str], combined: dict[str, Column]) -> DataFrame:
    """Nodes of classes of blocks. Where a class is alone its turns are its nodes; siblings are
    taken apart and equal turns combined."""
    rows = classes.select("forked", *combined, F.inline("turns"))
    alone = rows.filter("not forked").select(*_NODE, *fixed, *combined)
    parted = rows.filter("forked").groupBy(*_NODE).agg(*[F.min(c).alias(c) for c in fixed], *[c.alias(n) for n, c in combined.items()])
    return alone.unionByName(parted)


def _end_digests(last: DataFrame, hot_rows: int | None) -> DataFrame:
    """(node, sha): SHA-256 of the comma-joined ids that end at each node, in order. Ids are
    joined in pieces by many tasks; the hash itself goes over the pieces in order."""
    pieces = in_chunks(last, _NODE, F.col("conv"), [F.col("conv")], "ids", hot_rows=hot_rows)
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    pieces = pieces.select(*_NODE, "chunk", text.alias("ids")).repartition(*_NODE).sortWithinPartitions(*_NODE, "chunk")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha = None, None
        for batch in batches:
            out = []
            for *node, _, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if node == held:
                    sha.update(b",")
                else:
                    if held:
                        out.append((*held, sha.hexdigest()))
                    held, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield _node_batch(out)
        if held:
            yield _node_batch([(*held, sha.hexdigest())])

    return pieces.mapInArrow(digest, "depth long, x long, y long, ends_sha256 string")


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [*_NODE, "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id (its smallest conversation), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: (conv, pos, digest, bytes) as of ``ordered_turns``, positions from 1 without gaps;
    ``convs``: (conv) of all conversations, those without turns too; repeated ones count once. The
    root has depth 0 and no parent. Without conversations there are no rows. Turns are equal when
    their 128-bit digests are, prefixes when 128-bit digests over digests and positions are.

    Conversations, nodes and parents that own very many rows (``hot_rows``) are joined apart, ids
    are listed in pieces, and nothing is collected but at most ``BLOCK`` turns of one block.
    """
    convs = cut(convs.select(F.col("conv").cast("long").alias("conv")).filter("conv is not null").distinct())
    blocks = cut(_blocks(turns))
    n_blocks = blocks.count()
    found = blocks.groupBy(*_CLASS).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.min("sx").alias("sx"), F.min("sy").alias("sy"), F.first("turns").alias("turns")
    )
    found = cut(found)
    siblings = found.groupBy("block", "sx", "sy").agg((F.count(F.lit(1)) > 1).alias("forked"))
    classes = cut(join_unique(found, siblings, ["block", "sx", "sy"], hot_rows=hot_rows, at_most=n_blocks))
    release(found)
    root = {c: F.lit(0).cast("long").alias(c) for c in (*_NODE, "px", "py", "before", "end")}
    top = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")).filter("n > 0").select(*root.values(), "n", "conv")
    made = _refined(classes, ["px", "py", "before", "end"], {"n": F.sum("n"), "conv": F.min("conv")})
    nodes = cut(made.unionByName(top))
    n_nodes = nodes.count()

    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    kids = cut(kids)
    leaves = nodes.join(kids, _NODE, "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    # what a conversation shares with smaller ones: whole blocks, then turns of the block where it parts
    in_blocks = join_unique(blocks.select("conv", *_CLASS, "end"), classes.select(*_CLASS, F.col("conv").alias("owner")), _CLASS, hot_rows=hot_rows, at_most=n_blocks)
    parting = classes.filter("forked").select(F.col("conv").alias("member"), F.inline("turns"))
    parting = parting.join(nodes.select(*_NODE, F.col("conv").alias("owner")), _NODE).filter("owner < member").select(F.col("member").alias("conv"), "end")
    shared = in_blocks.filter("owner < conv").select("conv", "end").unionByName(parting).groupBy("conv").agg(F.max("end").alias("shared"))
    values = convs.join(shared, "conv", "left").join(leaves, "conv", "left").na.fill(0, ["shared", "leaf"])
    values = cut(values)
    of_class = join_unique(blocks.select("conv", *_CLASS), values, ["conv"], hot_rows=hot_rows, at_most=n_blocks).groupBy(*_CLASS).agg(
        F.sum("shared").alias("shared"), F.sum("leaf").alias("leaf")
    )
    sums = _refined(classes.join(of_class, _CLASS), [], {"shared": F.sum("shared"), "leaf": F.sum("leaf")})
    sums = sums.unionByName(values.agg(F.sum("shared").alias("shared"), F.sum("leaf").alias("leaf")).select(*[root[c] for c in _NODE], "shared", "leaf"))

    last = blocks.groupBy("conv").agg(F.max_by(F.struct("depth", F.col("ex").alias("x"), F.col("ey").alias("y")), "depth").alias("at"))
    zero = F.lit(0).cast("long")
    last = cut(convs.join(last, "conv", "left").select("conv", *[F.coalesce(F.col("at")[c], zero).alias(c) for c in _NODE]))
    ends = _end_digests(last, hot_rows)

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("parent_conv_id"))
    out = join_unique(nodes, parents, ["depth", "px", "py"], "left", hot_rows, n_nodes)
    out = out.join(kids, _NODE, "left").join(sums, _NODE).join(ends, _NODE, "left")
    owners = values.select("conv", F.col("shared").alias("own"))
    out = join_unique(out, owners, ["conv"], hot_rows=hot_rows, at_most=n_nodes)
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"),
        F.col("leaf").alias("n_leaves"), (F.col("shared") - F.col("own") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
