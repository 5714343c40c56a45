"""Balancing blocks into edge partitions.

Tables of edges and of seeds stay in Spark, whatever their number. Only the sequential merges fold
a table of blocks on the driver; how many blocks that may be is their ``max_blocks``.
"""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, release, settled
from ..skew import BROADCAST_ROWS, join_small, join_spread, join_unique, number_all, number_within, running_sum
from .blocks import NO_BLOCK
from .relational import union_rows
from .seeds import first_independent

#: blocks that a merge folds on the driver if the caller names no other number
MAX_BLOCKS = 1_000_000
_NEAR = 1_000  # proposals that stay between a seed's two lines at least
_TABLES = 16  # round tables kept apart before they are written together
_SET = 256  # blocks of one vertex that are held as a set
_AHEAD_ROWS = 262_144  # rows of vertex counts by which a merge decides ahead
_SLOT_ROWS = 4_096  # smallest width of the number buckets of the residual range join
_SLOT_PIECES = 50_000  # most buckets


def block_rows(table: DataFrame, *columns: str, max_blocks: int = MAX_BLOCKS) -> list:
    """Block-level rows on the driver, behind a size check."""
    rows = table.select(*columns).limit(max_blocks + 1).collect()
    if len(rows) > max_blocks:
        raise ValueError(f"more than {max_blocks} blocks; merge seeds first or raise max_blocks")
    return rows


def default_cap(n_edges: int, n_seeds: int) -> int:
    return n_edges // n_seeds + 1


def _reaches(line: str) -> Column:
    """Is (key, edge_id) at or above the line? No line counts as one below all."""
    key, at = F.col("key"), F.col(line)
    return at.isNull() | (key > at) | ((key == at) & (F.col("edge_id") <= F.col(f"{line}_edge")))


def _proposals(rows: DataFrame, state: DataFrame, n_seeds: int) -> DataFrame:
    """(edge_id, seed, key, rest): the first entry of ``rest`` whose seed is listed and still open
    to the edge, and the entries after it."""
    entry = rows.select("edge_id", F.posexplode("rest").alias("pos", "e")).select("edge_id", "pos", F.col("e.seed").alias("seed"), F.col("e.score").alias("key"))
    is_open = join_small(entry, state.select("seed", "room", "bar", "bar_edge"), n_seeds, ["seed"]).filter((F.col("room") > 0) & _reaches("bar"))
    listed = is_open.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("pos", "seed", F.col("key").alias("score")))).alias("open"))
    rest = F.transform(F.slice("open", 2, F.greatest(F.size("open") - 1, F.lit(0))), lambda e: F.struct(e["seed"].alias("seed"), e["score"].alias("score")))
    return listed.select("edge_id", F.col("open")[0]["seed"].alias("seed"), F.col("open")[0]["score"].alias("key"), rest.alias("rest"))


def capped_assign(
    profiles: DataFrame, seeds: DataFrame, cap: int | None = None, room: DataFrame | None = None,
    hot_rows: int | None = None, progress: list[dict] | None = None,
) -> DataFrame:
    """(edge_id, src, dst, block) as a scan of all (edge, seed, score) by score descending
    would give: an edge goes to the first seed on its profile that is not full; -1 if all are.

    Edges propose to their best seed still open to them; a seed over its cap raises its bar
    to its cap-th best proposal, and edges below it move on. Bars only rise, so this ends,
    and since both sides rank by the same score the outcome is the scan's. ``room(seed, room)``
    gives a cap per seed, else every seed has ``cap``.

    Proposals are logged and carry the rest of their profile; those that reach their seed's bar
    hold. Each seed that was ever over its cap also has a second line above the bar: only the
    proposals between the lines and the new ones are looked at, to find which must go. Proposals
    above that line are read again only when the room between the lines is used up. So a round
    reads about as many rows as were refused before it; ``progress`` receives these counts.
    """
    profiles = settled(profiles)
    listed = seeds.select("seed").distinct()
    if room is None:
        cap = default_cap(profiles.count(), listed.count()) if cap is None else cap
        room = listed.withColumn("room", F.lit(cap).cast("long"))
    zero, never = F.lit(0).cast("long"), F.lit(None).cast("double")
    lines = [never.alias("bar"), zero.alias("bar_edge"), never.alias("line"), zero.alias("line_edge")]
    state = cut(room.select("seed", F.col("room").cast("long").alias("room"), zero.alias("live"), zero.alias("near"), *lines))
    n_seeds, lowest = state.agg(F.count(F.lit(1)), F.min("room")).first()
    whole = profiles.filter(F.size("profile") > 0).select("edge_id", F.col("profile").alias("rest"))
    named = whole.select(F.explode("rest.seed").alias("seed")).distinct()
    if n_seeds and lowest > 0 and named.join(state.select("seed"), "seed", "left_anti").isEmpty():
        first = F.col("rest")[0]
        started = whole.select("edge_id", first["seed"].alias("seed"), first["score"].alias("key"), F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))).alias("rest"))
    else:
        started = _proposals(whole, state, n_seeds)
    new = cut(started)
    log, near = [new], None
    columns = ["edge_id", "seed", "key", "rest"]
    while True:
        against = lambda lines: join_small(new, lines.select("seed", "line", "line_edge"), n_seeds, ["seed"])  # noqa: B023, E731
        came = against(state).groupBy("seed").agg(F.count(F.lit(1)).alias("came"), F.sum((~_reaches("line")).cast("long")).alias("under"))
        live, under = F.col("live") + F.coalesce("came", zero), F.col("near") + F.coalesce("under", zero)
        seen = state.join(came, "seed", "left").withColumn("live", live).withColumn("near", under).drop("came", "under")
        seen = seen.withColumn("excess", F.greatest(F.col("live") - F.col("room"), zero))
        # the bar after this round must lie between the lines too
        seen = cut(seen.withColumn("again", (F.col("excess") > 0) & (F.col("excess") >= F.col("near"))))
        release(state)
        state = seen
        over = F.col("excess") > 0
        n_over, n_again, most, reread = state.agg(
            F.count_if(over), F.count_if("again"), F.sum(F.when(over & ~F.col("again"), F.col("near"))), F.sum(F.when(F.col("again"), F.col("live")))
        ).first()
        if progress is not None:
            progress.append({"new": new.count(), "near": most or 0, "reread": reread or 0})
        if not n_over:
            break
        wanted = state.filter(over)
        known = against(state).filter(~_reaches("line")).select(*columns)
        known = known if near is None else known.unionByName(near.select(*columns))
        rows = join_small(known, wanted.filter("not again").select("seed", "excess"), n_over, ["seed"])
        if n_again:
            held = join_small(union_rows(*log), wanted.filter("again").select("seed", "excess", "bar", "bar_edge"), n_again, ["seed"])
            rows = rows.unionByName(held.filter(_reaches("bar")).select(*rows.columns))
        spare = F.col("excess") * 3 + _NEAR
        ranked = number_within(rows, ["seed"], [F.asc("key"), F.desc("edge_id")], "place", hot_rows, (most or 0) + (reread or 0))
        ranked = cut(ranked.filter(F.col("place") <= spare + 1))
        at = lambda p, name: F.max(F.when(F.col("place") == p, F.struct("key", "edge_id"))).alias(name)
        found = ranked.groupBy("seed").agg(
            at(F.col("excess") + 1, "b"), at(spare + 1, "l"), F.sum(((F.col("place") > F.col("excess")) & (F.col("place") <= spare)).cast("long")).alias("kept")
        )
        next_state = state.join(found, "seed", "left")
        kept = lambda new_value, old: F.when(over, new_value).otherwise(F.col(old)).alias(old)
        full = F.lit(float("inf"))
        next_state = cut(next_state.select(
            "seed", "room", F.least("live", F.greatest("room", zero)).alias("live"), kept(F.coalesce("kept", zero), "near"),
            kept(F.coalesce(F.col("b.key"), full), "bar"), kept(F.coalesce(F.col("b.edge_id"), zero), "bar_edge"),
            kept(F.coalesce(F.col("l.key"), F.when(F.col("again"), full).otherwise(F.col("line"))), "line"),
            kept(F.coalesce(F.col("l.edge_id"), F.when(F.col("again"), zero).otherwise(F.col("line_edge"))), "line_edge"),
        ))
        calm = join_small(known, state.filter(~over).select("seed"), n_seeds, ["seed"], "left_semi")
        between = ranked.filter((F.col("place") > F.col("excess")) & (F.col("place") <= spare)).select(*columns)
        next_near = cut(calm.select(*columns).unionByName(between))
        new = cut(_proposals(ranked.filter(F.col("place") <= F.col("excess")), next_state, n_seeds))
        for table in (near, ranked, state):
            release(table)
        near, state = next_near, next_state
        log.append(new)
    picks = join_small(union_rows(*log).select("edge_id", "seed", "key"), state.select("seed", "bar", "bar_edge"), n_seeds, ["seed"])
    picks = cut(picks.filter(_reaches("bar")).select("edge_id", F.col("seed").alias("block")))
    for table in (*log, near, state):
        release(table)
    placed = profiles.select("edge_id", "src", "dst").join(picks, "edge_id", "left")
    return placed.select("edge_id", "src", "dst", F.coalesce("block", F.lit(NO_BLOCK)).alias("block"))


def partial_reschedule(
    profiles: DataFrame, seeds: DataFrame, cap: int | None = None, share: float = 0.1, hot_rows: int | None = None
) -> DataFrame:
    """Every seed keeps its best ``floor(cap * (1 - share))`` own edges; only the others are
    offered again, into the room left. Kept edges are never displaced."""
    profiles = settled(profiles)
    listed = seeds.select("seed").distinct()
    cap = default_cap(profiles.count(), listed.count()) if cap is None else cap
    keep = int(cap * (1 - share))
    best = F.get("profile", F.lit(0))
    own = profiles.filter(F.size("profile") > 0).select(
        "edge_id", "src", "dst", best["seed"].alias("block"), best["score"].alias("key")
    )
    placed = number_within(own, ["block"], [F.desc("key"), F.asc("edge_id")], "place", hot_rows)
    kept = cut(placed.filter(F.col("place") <= keep).select("edge_id", "src", "dst", "block"))
    rest = cut(profiles.join(kept.select("edge_id"), "edge_id", "left_anti"))
    room = _vacancies(kept, listed, cap).select("seed", F.col("free").alias("room"))
    return kept.unionByName(capped_assign(rest, seeds, room=room, hot_rows=hot_rows))


def _vacancies(assigned: DataFrame, seeds: DataFrame, cap: int) -> DataFrame:
    """``seeds`` with ``free``: the places a cap leaves them."""
    load = assigned.groupBy(F.col("block").alias("seed")).agg(F.count(F.lit(1)).alias("_n"))
    return seeds.join(load, "seed", "left").withColumn("free", F.lit(cap) - F.coalesce("_n", F.lit(0))).drop("_n")


def _fill(assigned: DataFrame, vacancies: DataFrame, target: str, order: list[str]) -> DataFrame:
    """Hand the edges of block -1, in edge order, to ``target`` values with ``free`` places, in
    the given order of ``vacancies``.

    A range join of edge numbers with places, as an equi-join on number buckets: the places
    are cut into a bounded number of pieces, so they can be broadcast and no edge moves.
    """
    residual = number_all(assigned.filter(F.col("block") == NO_BLOCK), [F.col("edge_id")], "_n")
    open_places = running_sum(vacancies.filter("free > 0"), [F.col(c) for c in order], "free", "_from")
    slots = cut(open_places.select(target, "_from", (F.col("_from") + F.col("free")).alias("_to")))
    n, places = slots.agg(F.count(F.lit(1)), F.coalesce(F.max("_to"), F.lit(0))).first()
    width = max(_SLOT_ROWS, places // _SLOT_PIECES + 1)
    ranges = slots.withColumn("_b", F.explode(F.expr(f"sequence(_from div {width}, (_to - 1) div {width})")))
    if n + _SLOT_PIECES <= BROADCAST_ROWS:
        ranges = F.broadcast(ranges)
    keyed = residual.withColumn("_bucket", F.expr(f"_n div {width}"))
    inside = (F.col("_bucket") == F.col("_b")) & (F.col("_n") >= F.col("_from")) & (F.col("_n") < F.col("_to"))
    return keyed.join(ranges, inside, "left").drop("_b", "_bucket", "_n", "_from", "_to")


def fill_residual(assigned: DataFrame, seeds: DataFrame, cap: int) -> DataFrame:
    """Put edges of block -1 into the free places of the seeds, in the order of ``seeds``
    (its ``rank`` column if it has one, as ``read_seeds`` gives, else by id). Each edge is
    placed once; edges beyond all free places stay -1."""
    assigned = settled(assigned)
    order = ["rank", "seed"] if "rank" in seeds.columns else ["seed"]
    vacancies = _vacancies(assigned, seeds.select(*order), cap)
    filled = _fill(assigned, vacancies, "seed", order)
    filled = filled.withColumn("block", F.coalesce("seed", F.lit(NO_BLOCK))).select("edge_id", "src", "dst", "block")
    before = assigned.filter(F.col("block") != NO_BLOCK).select("edge_id", "src", "dst", "block")
    return before.unionByName(filled)


def merge_blocks_lpt(sizes: DataFrame, parts: int, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(block, part): blocks by size descending, each to the smallest partition so far. A
    sequential rule: at most ``max_blocks`` rows of ``sizes`` are folded on the driver."""
    rows = [r for r in block_rows(sizes, "block", "n_edges", max_blocks=max_blocks) if r["block"] != NO_BLOCK]
    if len(rows) < parts:
        raise ValueError(f"{len(rows)} blocks cannot open {parts} partitions")
    heap = [(0, p) for p in range(parts)]
    merged = []
    for r in sorted(rows, key=lambda r: (-r["n_edges"], r["block"])):
        load, p = heapq.heappop(heap)
        merged.append((r["block"], p))
        heapq.heappush(heap, (load + r["n_edges"], p))
    return sizes.sparkSession.createDataFrame(merged, "block long, part int")


def block_vertices(blocks: DataFrame) -> DataFrame:
    """Distinct (block, id) of the ends of each block's edges."""
    ends = blocks.filter(F.col("block") != NO_BLOCK).select("block", F.explode(F.array("src", "dst")).alias("id"))
    return ends.distinct()


def block_overlaps(members: DataFrame, chunk: int = _SET) -> DataFrame:
    """(a, b, shared) with a < b: vertices two blocks have in common.

    Vertices with the same set of at most ``chunk`` blocks are counted first, so pairs are formed
    once per distinct set and not once per vertex. The set of a vertex in more blocks is cut into
    chunks that meet in pairs, each pair a row of its own, so a hub's pairs spread over tasks.
    """
    members = settled(members)
    wide = cut(members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk))
    n_wide = wide.count()
    narrow = join_small(members, wide.select("id"), n_wide, ["id"], "left_anti") if n_wide else members
    sets = narrow.groupBy("id").agg(F.sort_array(F.collect_set("block")).alias("blocks")).filter(F.size("blocks") > 1)
    counted = sets.groupBy("blocks").agg(F.count(F.lit(1)).alias("n"))
    firsts = counted.select("n", "blocks", F.posexplode("blocks").alias("i", "a"))
    pairs = firsts.select("n", "a", F.explode(F.expr("slice(blocks, i + 2, size(blocks))")).alias("b"))
    if n_wide:
        pieces = F.expr(f"(n - 1) div {chunk} + 1").cast("int")
        hub = join_small(members, wide, n_wide, ["id"]).select("id", "block", pieces.alias("pieces"))
        # a block lies in the same piece for every vertex of as many pieces
        hub = hub.withColumn("piece", F.pmod(F.xxhash64("block"), F.col("pieces")).cast("int"))
        hub = hub.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        cell = [F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q")]
        met = hub.select("id", *cell, (F.col("piece") > F.col("other")).alias("late"), "block").groupBy("id", "p", "q").agg(
            F.collect_set(F.when(~F.col("late"), F.col("block"))).alias("x"), F.collect_set(F.when(F.col("late"), F.col("block"))).alias("y")
        )
        same = met.filter("p = q").select(F.explode("x").alias("l"), "x").select("l", F.explode("x").alias("r")).filter("l < r")
        cross = met.filter("p < q").select(F.explode("x").alias("l"), "y").select("l", F.explode("y").alias("r"))
        ordered = same.unionByName(cross).select(F.lit(1).cast("long").alias("n"), F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"))
        pairs = pairs.unionByName(ordered)
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("shared"))


def pick_initial_blocks(
    sizes: DataFrame, members: DataFrame, overlaps: DataFrame, parts: int, inter_fac: float
) -> DataFrame:
    """(block, part): blocks by size descending, accepted while their vertex overlap with each
    accepted block is at most ``inter_fac`` of both vertex sets; the first ``parts`` of them."""
    wanted = sizes.filter(F.col("block") != NO_BLOCK)
    count = members.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    conflicts = (
        overlaps.join(count.select(F.col("block").alias("a"), F.col("n").alias("n_a")), "a")
        .join(count.select(F.col("block").alias("b"), F.col("n").alias("n_b")), "b")
        .filter(F.col("shared") > inter_fac * F.least("n_a", "n_b"))
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
    )
    ranked = number_all(wanted, [F.desc("n_edges"), F.asc("block")], "rank", 1).select(F.col("block").alias("id"), "rank")
    first = block_rows(first_independent(ranked, conflicts, parts), "id", "rank")
    if len(first) < parts:
        raise ValueError(f"only {len(first)} of {parts} initial blocks; lower the overlap demand (inter_fac)")
    opened = [(r["id"], p) for p, r in enumerate(sorted(first, key=lambda r: r["rank"]))]
    return sizes.sparkSession.createDataFrame(opened, "block long, part int")


class _Ahead:
    """What the driver knows of one partition since its overlaps were last counted: the best open
    blocks with their exact overlaps, how many vertices outside the partition lie in which of
    them, and a bound for all other blocks."""

    def __init__(self, shown: list[tuple[int, int]], bound: int, patterns: list[tuple[int, int]]):
        self.bit = {block: i for i, (block, _) in enumerate(shown)}
        self.overlap = dict(shown)
        self.bound = bound  # the most that a block not shown may share
        self.patterns = dict(patterns)
        self.grown = False

    def best(self, left: set[int], edges: dict[int, int], others: bool) -> int | None:
        """The block the partition takes, or None if one that is not shown might come before."""
        open_now = [b for b in self.overlap if b in left]
        if not open_now:
            return None
        block = min(open_now, key=lambda b: (-self.overlap[b], -edges[b], b))
        sure = not others or not self.grown or self.overlap[block] > self.bound
        return block if sure else None

    def take(self, block: int) -> None:
        mine, new = 1 << self.bit[block], 0
        for mask in [m for m in self.patterns if m & mine]:
            n = self.patterns.pop(mask)
            new += n
            for b, i in self.bit.items():
                if mask >> i & 1:
                    self.overlap[b] += n
        self.bound += new  # a block not shown may hold all of them
        self.grown = self.grown or new > 0


def merge_blocks_overlap(
    sizes: DataFrame, members: DataFrame, parts: int, inter_fac: float, max_blocks: int = MAX_BLOCKS, progress: list[int] | None = None
) -> DataFrame:
    """(block, part): the smallest partition repeatedly takes the unassigned block sharing most
    vertices with it, ties to the block with most edges, then to the smaller id.

    Overlaps are counted in Spark, for all partitions that grew since, and stay there. The driver
    gets each partition's best few open blocks, their exact overlaps, and how many vertices that
    the partition lacks lie in which of them (at most ``_AHEAD_ROWS`` rows for all partitions). By
    these it decides ahead exactly: taking a block adds the vertices it shares with the others.
    Blocks that are not shown are bounded by the worst shown one and the vertices gained; only
    where that bound reaches the best block are overlaps counted anew. ``progress`` receives the
    number of decisions after each count.
    """
    spark = sizes.sparkSession
    members = cut(members)
    edge_count = {r["block"]: r["n_edges"] for r in block_rows(sizes, "block", "n_edges", max_blocks=max_blocks) if r["block"] != NO_BLOCK}
    opened = block_rows(pick_initial_blocks(sizes, members, block_overlaps(members), parts, inter_fac), "block", "part")
    part_of = {r["block"]: r["part"] for r in opened}
    load = {r["part"]: edge_count[r["block"]] for r in opened}
    queue = [(n, p) for p, n in load.items()]
    heapq.heapify(queue)
    fresh = [(r["block"], r["part"]) for r in opened]
    left = set(edge_count) - set(part_of)
    by_edges = sorted(left, key=lambda b: (-edge_count[b], b))
    owned: list[DataFrame] = []  # (part, id) tables of the vertices taken in so far
    shared = None  # (part, block, n) of open blocks, for what is owned
    known: dict[int, _Ahead] = {}
    while left:
        open_blocks = cut(spark.createDataFrame([(b, edge_count[b]) for b in left], "block long, n_edges long"))
        open_members = join_small(members, open_blocks.select("block"), len(left), ["block"], "left_semi")
        stale = {p for _, p in fresh} | {queue[0][1]}
        if fresh:
            taken_now = spark.createDataFrame(fresh, "block long, part int")
            new = join_small(members, taken_now, len(fresh), ["block"]).select("part", "id").distinct()
            if owned:
                new = new.join(union_rows(*owned), ["part", "id"], "left_anti")
            new = cut(new)
            owned = [*owned, new] if len(owned) < _TABLES else [cut(union_rows(*owned, new))]
            gained = join_spread(new, open_members, ["id"]).groupBy("part", "block").agg(F.count(F.lit(1)).alias("n"))
            if shared is not None:
                gained = gained.unionByName(shared).groupBy("part", "block").agg(F.sum("n").alias("n"))
            counted = cut(join_small(gained, open_blocks.select("block"), len(left), ["block"], "left_semi"))
            release(shared)
            shared = counted
        known |= _looked_ahead(spark, shared, open_blocks, open_members, union_rows(*owned), stale, left, by_edges)
        release(open_blocks)
        fresh = []
        while left:
            _, p = queue[0]
            shown = known[p]
            block = shown.best(left, edge_count, len(left) > len(shown.bit) or any(b not in shown.bit for b in left))
            if block is None:
                break
            part_of[block] = p
            load[p] += edge_count[block]
            heapq.heapreplace(queue, (load[p], p))
            left.remove(block)
            shown.take(block)
            fresh.append((block, p))
        if progress is not None:
            progress.append(len(fresh))
    return spark.createDataFrame(sorted(part_of.items()), "block long, part int")


def _looked_ahead(
    spark: SparkSession, shared: DataFrame, open_blocks: DataFrame, open_members: DataFrame, owned: DataFrame, stale: set[int], left: set[int], by_edges: list[int],
    width: int | None = None,
) -> dict[int, _Ahead]:
    """``_Ahead`` of the stale partitions, of ``width`` blocks each; empty if that gave too many rows."""
    if width is None:
        width = max(4, min(16, (_AHEAD_ROWS // len(stale)).bit_length() - 1))
        if len(stale) == 1 and width == 16:
            # one partition lags: more of its blocks, if the vertices lie in few enough sets of them
            wide = _looked_ahead(spark, shared, open_blocks, open_members, owned, stale, left, by_edges, 60)
            if wide:
                return wide
    wanted = spark.createDataFrame([(p,) for p in sorted(stale)], "part int")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), F.desc("n_edges"), F.asc("block")))
    candidates = join_small(join_small(shared, wanted, len(stale), ["part"], "left_semi"), open_blocks, len(left), ["block"])
    top = candidates.withColumn("place", place).filter(F.col("place") <= width + 1).orderBy("part", "place").collect()
    shown: dict[int, list[tuple[int, int]]] = {p: [] for p in stale}
    for r in top:
        shown[r["part"]].append((r["block"], r["n"]))
    bound = {}
    fill = [b for b in itertools.islice((b for b in by_edges if b in left), 2 * width + 2)]
    for p, rows in shown.items():
        bound[p] = rows[width][1] if len(rows) > width else 0
        del rows[width:]
        have = {b for b, _ in rows}
        # blocks that share nothing come by their edges
        rows += [(b, 0) for b in fill if b not in have][: width - len(rows)] if bound[p] == 0 else []
    bits = [(p, b, 1 << i) for p, rows in shown.items() for i, (b, _) in enumerate(rows)]
    listed = spark.createDataFrame(bits, "part int, block long, bit long")
    if len(bits) <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    masks = open_members.join(listed, "block").groupBy("part", "id").agg(F.bit_or("bit").alias("mask"))
    counts = masks.join(owned, ["part", "id"], "left_anti").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    patterns: dict[int, list[tuple[int, int]]] = {p: [] for p in stale}
    # at most 2^width rows for each stale partition; a given width is tried up to a fixed number
    most = _AHEAD_ROWS if width > 16 else len(stale) << width
    found = counts.limit(most + 1).collect()
    if len(found) > most:
        return {}
    for r in found:
        patterns[r["part"]].append((r["mask"], r["n"]))
    return {p: _Ahead(shown[p], bound[p], patterns[p]) for p in stale}


def part_sizes(sizes: DataFrame, merge: DataFrame) -> DataFrame:
    """(part, n_edges) of merged blocks."""
    return sizes.join(merge, "block").groupBy("part").agg(F.sum("n_edges").alias("n_edges"))


def water_fill(sizes: DataFrame, residual: int, max_parts: int = MAX_BLOCKS) -> DataFrame:
    """(part, n_edges, quota): spread ``residual`` edges so the smallest partitions rise
    together; what does not divide goes to the smallest. No partitions, no rows. At most
    ``max_parts`` rows of ``sizes`` are folded on the driver.

    Closed form over the partition table: the k smallest rise to one level, k the largest
    count for which reaching the k-th size costs no more than the residual.
    """
    rows = sorted((r["n_edges"], r["part"]) for r in block_rows(sizes, "part", "n_edges", max_blocks=max_parts))
    if not rows:
        return sizes.sparkSession.createDataFrame([], "part long, n_edges long, quota long")
    raised, total, filled = 0, 0, 0
    for k, (n, _) in enumerate(rows, 1):
        total += n
        if k * n - total <= residual:
            raised, filled = k, total
    level, spare = divmod(filled + residual, raised)
    quotas = [(part, n, level - n if k < raised else 0) for k, (n, part) in enumerate(rows)]
    part, n, quota = quotas[0]
    quotas[0] = (part, n, quota + spare)
    return sizes.sparkSession.createDataFrame(quotas, "part long, n_edges long, quota long")


def materialize_partitions(blocks: DataFrame, merge: DataFrame, quotas: DataFrame) -> DataFrame:
    """(edge_id, src, dst, part): edges of merged blocks in their partition, edges of block -1
    dealt out by quota in edge order."""
    blocks = settled(blocks)
    merged = join_unique(blocks.filter(F.col("block") != NO_BLOCK), merge.select("block", F.col("part").cast("int").alias("part")), ["block"])
    shares = quotas.select(F.col("part").cast("long").alias("part"), F.col("quota").alias("free"))
    dealt = _fill(blocks, shares, "part", ["part"]).select("edge_id", "src", "dst", F.col("part").cast("int").alias("part"))
    return merged.select("edge_id", "src", "dst", "part").unionByName(dealt)


def balance_stats(sizes: DataFrame) -> DataFrame:
    """One row: integer average, SD over the integer average, their ratio, and stddev_pop."""
    total = sizes.agg(F.sum("n_edges").alias("s"), F.count(F.lit(1)).alias("p")).first()
    if not total["p"]:
        return sizes.sparkSession.createDataFrame([], "average long, sd double, stddev_pop double, sd_share double")
    average = total["s"] // total["p"]
    squares = f"sum((n_edges - {average}) * (n_edges - {average}))"
    return sizes.agg(
        F.lit(average).cast("long").alias("average"),
        F.sqrt(F.expr(f"{squares} div {total['p']}")).alias("sd"),
        F.stddev_pop("n_edges").alias("stddev_pop"),
    ).withColumn("sd_share", F.try_divide("sd", "average"))
