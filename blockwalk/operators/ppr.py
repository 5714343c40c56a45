"""Personalized PageRank tables in long form (id, target, score).

A vertex's score for a target is the sum over paths of the product of hop_factor / out-degree.
Scores flow against the edges: a vertex reads the rows of its out-neighbors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..runtime import cut, iterate, release
from ..skew import hot_keys, join_both
from .blocks import spread_mass

HOP_FACTOR = 0.15  # fixed value: teleport constant, the weight of one hop


def _one_hop(graph: Graph, hop_factor: float, targets: DataFrame | None) -> DataFrame:
    """(id, target, score) of the direct edges; parallel edges each count."""
    edges = graph.weighted_edges().withColumn("_w", F.lit(hop_factor) / F.col("out_deg"))
    if targets is not None:
        edges = edges.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
    return edges.groupBy(F.col("src").alias("id"), F.col("dst").alias("target")).agg(F.sum("_w").alias("score"))


def _pulled(graph: Graph, rows: DataFrame, value: str, hop_factor: float) -> DataFrame:
    """Rows of a vertex as its in-neighbors see them: ``value`` times hop_factor / out-degree."""
    sent = graph.links("in").join(rows, many=True)
    return sent.withColumn(value, F.col(value) * (F.lit(hop_factor) / F.col("out_deg"))).drop("at").withColumnRenamed("to", "id")


def inverse_p_distance(
    graph: Graph, iterations: int, hop_factor: float = HOP_FACTOR, targets: DataFrame | None = None
) -> DataFrame:
    """Scores over all paths of up to 1 + iterations hops. ``targets(id)`` limits the table,
    which otherwise grows to the square of the vertices."""
    base = cut(_one_hop(graph, hop_factor, targets))

    def step(state, _):
        pulled = _pulled(graph, state, "score", hop_factor).select("id", "target", "score")
        return pulled.unionByName(base).groupBy("id", "target").agg(F.sum("score").alias("score"))

    return iterate(base, step, iterations)


def inverse_p_distance_from(graph: Graph, sources: DataFrame, iterations: int, hop_factor: float = HOP_FACTOR) -> DataFrame:
    """The rows of ``sources(id)`` in ``inverse_p_distance``, without the rest of the table: mass
    flows forward from each source, so a round costs the edges that its sources have reached."""
    links = graph.links("out")
    state = cut(sources.select("id").distinct().select(F.col("id").alias("source"), "id", F.lit(1.0).alias("w")))
    found = None
    for _ in range(1 + iterations):
        sent = links.join(state, many=True).withColumn("w", F.col("w") * (F.lit(hop_factor) / F.col("out_deg")))
        arrived = cut(sent.groupBy("source", F.col("to").alias("id")).agg(F.sum("w").alias("w")))
        part = arrived.select("source", F.col("id").alias("target"), F.col("w").alias("score"))
        found = part if found is None else found.unionByName(part)
        state = arrived
    return found.groupBy(F.col("source").alias("id"), "target").agg(F.sum("score").alias("score"))


def inverse_p_distance_with_length(
    graph: Graph, iterations: int, hop_factor: float = HOP_FACTOR, targets: DataFrame | None = None
) -> DataFrame:
    """The same with ``max_len``, the longest path length met for the pair."""
    base = cut(_one_hop(graph, hop_factor, targets).withColumn("max_len", F.lit(1)))

    def step(state, _):
        pulled = _pulled(graph, state, "score", hop_factor)
        pulled = pulled.select("id", "target", "score", (F.col("max_len") + 1).alias("max_len"))
        return pulled.unionByName(base).groupBy("id", "target").agg(
            F.sum("score").alias("score"), F.max("max_len").alias("max_len")
        )

    return iterate(base, step, iterations)


def _compose(a: DataFrame, b: DataFrame, hot_rows: int | None) -> DataFrame:
    """Score product summed over the middle vertex."""
    first = a.select("id", F.col("target").alias("mid"), F.col("score").alias("s1"))
    second = b.select(F.col("id").alias("mid"), "target", F.col("score").alias("s2"))
    met = join_both(first, second, ["mid"], hot_keys(first, ["mid"], hot_rows), hot_rows)
    return met.groupBy("id", "target").agg(F.sum(F.col("s1") * F.col("s2")).alias("score"))


def _add(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("id", "target").agg(F.sum("score").alias("score"))


def _dropped(table: DataFrame, floor: float) -> float:
    """The most that a row of the table loses by leaving out scores up to ``floor``."""
    lost = table.filter(F.col("score") <= floor).groupBy("id").agg(F.sum("score").alias("s"))
    return lost.agg(F.max("s")).first()[0] or 0.0


def inverse_p_distance_doubling(
    graph: Graph, rounds: int, hop_factor: float = HOP_FACTOR, mode: str = "exact", floor: float = 0.0,
    targets: DataFrame | None = None, report: list[dict] | None = None,
) -> DataFrame:
    """Scores reaching 2, 4, 8 ... hops by composing tables with themselves.

    ``exact`` keeps the power and the sum (S + A S, A A) and equals ``inverse_p_distance`` at
    depth 2^rounds; ``recurrence`` is D + D D, which counts some paths more than once.

    ``floor`` drops smaller scores after each round to bound the table. ``report`` then receives
    per round how many rows are left and ``error``, which no score is further from its exact
    value: each row's sum is wrong by what it lost, and by what its factors had lost before (a
    row of the power sums to at most hop_factor^hops). This bound is for mode ``exact``.

    ``targets(id)`` limits the table to these columns in every round: no power is formed, but
    the edges are applied to them as often as it stands for, so no table exceeds vertices times
    targets.
    """
    if targets is not None:
        return _doubling_toward(graph, rounds, hop_factor, mode, floor, targets)
    sums = cut(_one_hop(graph, hop_factor, None))
    power = sums
    error_sum = error_power = 0.0
    for i in range(rounds):
        hops = 2**i
        composed = _add(sums, _compose(sums if mode == "recurrence" else power, sums, graph.hot_rows))
        whole = cut(composed)
        new_sums = whole.filter(F.col("score") > floor)
        if report is not None:
            at_most = sum(hop_factor**k for k in range(1, hops + 1))
            error_sum += error_power * at_most + hop_factor**hops * error_sum + _dropped(whole, floor)
            report.append({"round": i + 1, "rows": new_sums.count(), "error": error_sum if mode == "exact" else None})
        if mode == "exact" and i + 1 < rounds:
            squared = cut(_compose(power, power, graph.hot_rows))
            new_power = squared.filter(F.col("score") > floor)
            if report is not None:
                error_power = 2 * error_power * hop_factor**hops + _dropped(squared, floor)
            if power is not sums:
                release(power)
            new_power.work_path = squared.work_path
            power = new_power
        elif mode == "exact" and power is not sums:
            release(power)
        if i > 0 or mode == "recurrence":
            release(sums)
        new_sums.work_path = whole.work_path
        sums = new_sums
    return sums


def _doubling_toward(graph: Graph, rounds: int, hop_factor: float, mode: str, floor: float, targets: DataFrame) -> DataFrame:
    """The columns of ``targets`` in the doubled tables."""

    def hop(rows: DataFrame) -> DataFrame:
        pulled = _pulled(graph, rows, "score", hop_factor).groupBy("id", "target").agg(F.sum("score").alias("score"))
        return cut(pulled.filter(F.col("score") > floor) if floor else pulled)

    def recurrence(rows: DataFrame, depth: int) -> DataFrame:
        """D + D D with the table of the round before, applied to ``rows``."""
        if not depth:
            return hop(rows)
        once = recurrence(rows, depth - 1)
        return cut(_add(once, recurrence(once, depth - 1)))

    if mode == "recurrence":
        own = targets.select("id").distinct().select("id", F.col("id").alias("target"), F.lit(1.0).alias("score"))
        return recurrence(cut(own), rounds)
    sums = cut(_one_hop(graph, hop_factor, targets))
    for i in range(rounds):
        moved = sums
        for _ in range(2**i):
            further = hop(moved)
            if moved is not sums:
                release(moved)
            moved = further
        added = cut(_add(sums, moved))
        release(moved)
        release(sums)
        sums = added
    return sums


def _delta_rounds(graph: Graph, rounds: int | None, hop_factor: float, delta: float, targets: DataFrame | None):
    """Yield (round, state before the round, state after) of the increment form."""
    state = cut(_one_hop(graph, hop_factor, targets).withColumn("inc", F.col("score")))
    done = 0
    while rounds is None or done < rounds:
        sending = state.filter(F.col("inc") > delta).select("id", "target", "inc")
        got = _pulled(graph, sending, "inc", hop_factor).select("id", "target", F.lit(0.0).alias("score"), "inc")
        held = state.select("id", "target", "score", F.lit(0.0).alias("inc"))
        merged = got.unionByName(held).groupBy("id", "target").agg(F.sum("score").alias("score"), F.sum("inc").alias("inc"))
        new = cut(merged.select("id", "target", (F.col("score") + F.col("inc")).alias("score"), "inc"))
        done += 1
        yield done, state, new
        release(state)
        state = new


def ppr_delta(
    graph: Graph, iterations: int, hop_factor: float = HOP_FACTOR, delta: float = 0.001, targets: DataFrame | None = None
) -> DataFrame:
    """(id, target, score, inc): only increments above ``delta`` are passed on."""
    new = None
    for done, _, new in _delta_rounds(graph, iterations, hop_factor, delta, targets):
        if done == iterations:
            break
    if new is None:
        return _one_hop(graph, hop_factor, targets).withColumn("inc", F.col("score"))
    return new


def ppr_delta_converge(
    graph: Graph, hop_factor: float = HOP_FACTOR, delta: float = 0.01, targets: DataFrame | None = None,
    max_rounds: int | None = None,
) -> DataFrame:
    """``ppr_delta`` until no increment is above ``delta``."""
    new = None
    for _, _, new in _delta_rounds(graph, max_rounds, hop_factor, delta, targets):
        if new.filter(F.col("inc") > delta).isEmpty():
            break
    return new


def message_elements(
    graph: Graph, iterations: int, hop_factor: float = HOP_FACTOR, delta: float = 0.0, targets: DataFrame | None = None
) -> DataFrame:
    """(round, elements): (target, score) elements sent in each round of ``ppr_delta``.

    Counted as active rows per vertex times its in-degree, without forming the messages.
    """
    incoming = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    rows = []
    for done, before, _ in _delta_rounds(graph, iterations, hop_factor, delta, targets):
        active = before.filter(F.col("inc") > delta).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        sent = active.join(incoming, "id").agg(F.coalesce(F.sum(F.col("n") * F.col("n_in")), F.lit(0)).alias("s")).first()["s"]
        rows.append((done, sent))
    return graph.edges.sparkSession.createDataFrame(rows, "round int, elements long")


def hub_ppr(
    graph: Graph, hubs: DataFrame, iterations: int, c: float = 0.15, rule: str = "reference", topk: int | None = None
) -> DataFrame:
    """(id, seed, score): hub mass flows along edges times (1 - c) / out-degree. Rule
    ``reference`` fades the old score by c where mass arrives, ``sum`` adds up."""
    return spread_mass(graph, hubs, iterations, topk, keep=1 - c, fade=c if rule == "reference" else None)


def scores_of(table: DataFrame, vertex: int) -> DataFrame:
    """The rows of one vertex."""
    return table.filter(F.col("id") == vertex)
