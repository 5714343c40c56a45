"""One entry per operator: (spark, sf_dir) -> DataFrame. Scores are reported in single
precision so that the order of a floating sum does not show."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwalk import Graph, build_graph, cut, message_step
from blockwalk.functions import map_add, map_scale, map_without, score_map
from blockwalk.operators import algorithms, balance, blocks, metrics, ppr, relational, strategies, topics, walks
from blockwalk.operators.seeds import spread_seeds, top_degree_seeds
from blockwalk.runtime import work_root
from blockwalk.skew import join_unique
from blockwalk.sources import edge_lists, partitions, results, seed_files

from .tables import buyer_topics, chain, customer_orders, once, table, topic_chain

SEEDS, ROUNDS, TOPK, PARTS = 16, 3, 5, 12
SAMPLINGS, STEPS = 2, 4
LENGTHS = walks.HUB_WALK_LENGTHS
LANDMARKS = 5
# blocks of the whole table share most of their vertices
OVERLAP = 0.9
PR_TOLERANCE = 0.05


def f32(name: str):
    return F.col(name).cast("float").cast("double").alias(name)


def long(name: str):
    return F.col(name).cast("long").alias(name)


# shared intermediate results ---------------------------------------------------------------

def _seeds(spark, d):
    return once(spark, d, "seeds", lambda: cut(top_degree_seeds(chain(spark, d).edges, SEEDS)))


def _scores(spark, d):
    return once(spark, d, "scores", lambda: cut(blocks.propagate(chain(spark, d), _seeds(spark, d), ROUNDS, TOPK)))


def _profiles(spark, d):
    return once(spark, d, "profiles", lambda: cut(blocks.edge_profiles(chain(spark, d), _scores(spark, d), TOPK)))


def _blocks(spark, d):
    # only the best entry is kept, so whole profiles are not written for it
    return once(spark, d, "blocks", lambda: cut(blocks.assign_blocks(blocks.edge_profiles(chain(spark, d), _scores(spark, d), TOPK))))


def _placed(spark, d):
    return strategies.edge_partition_2d(chain(spark, d).edges, PARTS, "affine")


def _walks(spark, d):
    return once(spark, d, "walks", lambda: cut(walks.walk_segments(chain(spark, d), SAMPLINGS, STEPS, mode="affine")))


# sources and sinks -------------------------------------------------------------------------

def _with_noise(lines: DataFrame) -> DataFrame:
    noise = lines.sparkSession.createDataFrame([("# comment",), ("",), ("77",)], "value string")
    return lines.union(noise)


def edge_list_parse(spark, d):
    gap = F.when(F.col("src") % 2 == 0, "\t").otherwise("  ")
    lines = chain(spark, d).edges.select(F.concat(F.col("src").cast("string"), gap, F.col("dst").cast("string")).alias("value"))
    return edge_lists.edges_from_lines(_with_noise(lines))


def attr_edge_list_parse(spark, d):
    lines = chain(spark, d).edges.select(F.concat_ws(" ", "src", F.concat(F.lit("t"), F.col("src") % 7), "dst").alias("value"))
    return edge_lists.attr_edges_from_lines(_with_noise(lines))


def labeled_edges(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    edges = chain(spark, d).edges
    lines = (
        edges.join(names.select(F.col("p_partkey").alias("src"), F.col("name").alias("a")), "src")
        .join(names.select(F.col("p_partkey").alias("dst"), F.col("name").alias("b")), "dst")
        .select(F.concat_ws(" ", "a", F.concat(F.lit("t"), F.col("src") % 3), "b").alias("value"))
    )
    vertices, parsed = edge_lists.labeled_edges_from_lines(_with_noise(lines))
    return edge_lists.name_edges(parsed, vertices).select("src_name", "attr", "dst_name")


def topic_edges(spark, d):
    lines = buyer_topics(spark, d).select(F.concat_ws("\t", "src", "dst", F.array_join("topics", ",")).alias("value"))
    parsed = edge_lists.topic_edges_from_lines(_with_noise(lines))
    return parsed.select("src", "dst", F.array_join("topics", "|").alias("topics"), F.size("topics").cast("long").alias("n_topics"))


def seed_file(spark, d):
    value = F.when(F.col("id") % 2 == 0, F.concat(F.lit("\t"), F.col("id") * F.lit(2.5))).otherwise("")
    lines = chain(spark, d).vertices.select(F.concat(F.col("id").cast("string"), value).alias("value"))
    return seed_files.seeds_from_lines(lines)


def seed_distance_text(spark, d):
    rows = chain(spark, d).edges.select(F.col("src").alias("id"), F.col("dst").alias("seed"), (F.col("dst") * 1.5).alias("score"))
    return results.seed_distances_from_lines(results.seed_distances_to_lines(rows))


def block_representative_text(spark, d):
    rows = chain(spark, d).edges.withColumn("block", F.col("src") % 50)
    lines = results.block_representatives_to_lines(blocks.block_representatives(rows))
    return results.block_representatives_from_lines(lines)


def partition_files(spark, d):
    path = f"{work_root(spark)}/files_{uuid.uuid4().hex}"
    partitions.write_partitioned_edges(_placed(spark, d), path)
    return partitions.read_partitioned_edges(spark, path).select("src", "dst", long("part"))


def partition_contents(spark, d):
    listed = partitions.partition_contents(_placed(spark, d), ["src", "dst"])
    as_text = F.transform("contents", lambda e: F.concat_ws("-", e["src"], e["dst"]))
    return listed.select(long("part"), "chunk", F.array_join(as_text, ",").alias("contents"))


def seed_round_trip(spark, d):
    """Seeds written and read again, with their place in the file."""
    path = f"{work_root(spark)}/files_{uuid.uuid4().hex}"
    seed_files.write_seeds(_seeds(spark, d).orderBy("seed").coalesce(1), path)
    return seed_files.read_seeds(spark, path).select("seed", "value", "rank")


def flat_edge_files(spark, d):
    """A flat folder of edge files: each file a partition, edges as they were loaded."""
    path = f"{work_root(spark)}/files_{uuid.uuid4().hex}"
    rows = chain(spark, d).edges.select(F.concat_ws("\t", "src", "dst").alias("value"), (F.col("src") % 3).alias("k"))
    for k in range(3):
        rows.filter(F.col("k") == k).select("value").coalesce(1).write.text(f"{path}/{k}")
    loaded = partitions.read_edge_files(spark, f"{path}/*")
    sizes = strategies.as_loaded(loaded).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("src"), F.sum("dst").alias("dst"))
    return sizes.select("n", "src", "dst")


def saved_vertices(spark, d):
    """A vertex result saved and read again."""
    path = f"{work_root(spark)}/files_{uuid.uuid4().hex}"
    results.save_vertices(relational.degrees(chain(spark, d).edges), path, "orc")
    return spark.read.orc(path)


def vertex_sample(spark, d):
    """A tenth of the vertices: is it part of them, and is its share near a tenth?"""
    whole = chain(spark, d).vertices.select("id")
    picked = cut(results.sample_vertices(whole, 0.1))
    tagged = whole.select("id", F.lit(1).alias("all"), F.lit(0).alias("got")).unionByName(picked.select("id", F.lit(0).alias("all"), F.lit(1).alias("got")))
    each = tagged.groupBy("id").agg(F.sum("all").alias("all"), F.sum("got").alias("got"))
    share = F.sum("got") / F.sum("all")
    return each.agg((F.max(F.col("got") - F.col("all")) <= 0).alias("is_subset"), share.between(0.05, 0.15).alias("near_a_tenth"))


def graph_counters(spark, d):
    """Counts and sums over the edge and vertex tables."""
    graph = chain(spark, d)
    return relational.counters(graph)


# graph building blocks ---------------------------------------------------------------------

def graph_vertices(spark, d):
    given = table(spark, d, "supplier").select((F.col("s_suppkey") + 500000).alias("id"), F.col("s_nationkey").cast("long").alias("n"))
    some = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("n"))
    return build_graph(chain(spark, d).edges, given.union(some), {"n": -5}).vertices.select("id", long("n"))


def degrees(spark, d):
    return relational.degrees(chain(spark, d).edges)


def neighbors(spark, d):
    edges = chain(spark, d).edges
    both = None
    for way in ("out", "in"):
        part = relational.neighbors(edges, way).select("id", "chunk", F.lit(way).alias("direction"), F.array_join("neighbors", ",").alias("ids"))
        both = part if both is None else both.unionByName(part)
    return both


def in_edges(spark, d):
    listed = relational.in_edges(chain(spark, d).edges, ["edge_id", "src"])
    return listed.select("id", "chunk", F.array_join(F.transform("edges", lambda e: F.concat_ws(":", e["edge_id"], e["src"])), ",").alias("edges"))


def _with_degree(spark, d) -> Graph:
    graph = chain(spark, d)
    return Graph(relational.attach(graph.vertices, relational.out_degrees(graph.edges), {"degree": 0}), graph.edges)


def triplets(spark, d):
    return relational.triplets(_with_degree(spark, d), ["degree"])


def edge_weights(spark, d):
    graph = relational.map_triplets(_with_degree(spark, d), ["degree"], weight=F.try_divide(F.lit(1.0), F.col("src_degree")))
    return relational.filter_edges(graph, F.col("weight") < 0.5).select("edge_id", "src", "dst", f32("weight"))


def mapped_graph(spark, d):
    """Vertices of some degree after a map over vertices, with what a map over edges gives their own."""
    graph = relational.map_vertices(_with_degree(spark, d), twice=F.col("degree") * 2)
    graph = relational.map_edges(graph, span=F.abs(F.col("src") - F.col("dst")))
    spans = relational.reduce_by_key(graph.edges, ["src"], spans=F.sum("span")).withColumnRenamed("src", "id")
    wanted = relational.filter_vertices(graph, F.col("twice") > 20).select("id", "twice")
    return relational.join_by_id(wanted, spans)


def attach(spark, d):
    return _with_degree(spark, d).vertices.select("id", "degree")


def union_with_defaults(spark, d):
    graph = chain(spark, d)
    top = relational.reduce_by_key(graph.edges, ["src"], best=F.max("dst")).withColumnRenamed("src", "id")
    return relational.union_with_defaults(graph.vertices, top, {"best": -1})


def degree_join(spark, d):
    edges = chain(spark, d).edges
    outs = relational.out_degrees(edges).withColumnRenamed("degree", "outs")
    return relational.join_by_id(outs, relational.in_degrees(edges).withColumnRenamed("degree", "ins"))


def edge_set_algebra(spark, d):
    edges = chain(spark, d).edges
    seeds = _seeds(spark, d)
    from_seeds = edges.join(seeds.select(F.col("seed").alias("src")), "src", "left_semi")
    to_seeds = edges.join(seeds.select(F.col("seed").alias("dst")), "dst", "left_semi")
    kept = relational.subtract_edges(edges, from_seeds)
    again = relational.select_edges(kept, to_seeds)
    return relational.union_edges(kept.select("edge_id", "src", "dst"), again.select("edge_id", "src", "dst"))


def set_sizes(spark, d):
    members = metrics.partition_vertices(_placed(spark, d)).withColumnRenamed("part", "block")
    return relational.set_sizes(members, F.col("block") == 0, F.col("block") == 1)


def top_edges(spark, d):
    graph = relational.map_triplets(_with_degree(spark, d), ["degree"], reach=F.col("src_degree") * F.col("dst_degree"))
    return relational.top_n(graph.edges, 50, [F.desc("reach"), F.asc("edge_id")]).select("edge_id", "reach")


def profile_entries(spark, d):
    rows = relational.explode_scores(_profiles(spark, d), "profile")
    return rows.select("edge_id", "seed", f32("score"))


def per_partition(spark, d):
    out = relational.per_partition(_placed(spark, d), n=F.count(F.lit(1)), low=F.min("src"), high=F.max("dst"))
    return out.select(long("part"), "n", "low", "high")


def message_round(spark, d):
    graph = chain(spark, d)
    low = relational.attach(graph.vertices, relational.out_degrees(graph.edges), {"degree": 0})
    step = message_step(
        graph.links("both"), low, {"v": F.col("at"), "w": F.col("degree")}, {"low": F.min("v"), "total": F.sum("w")},
        active=F.col("degree") > 2,
    )
    return step


def map_functions(spark, d):
    packed = score_map(_scores(spark, d), "m")
    doubled = map_add(F.col("m"), F.col("m"))
    halved = map_scale(doubled, F.lit(4.0))
    without = map_without(halved, F.col("id"))
    return packed.select("id", F.explode(without).alias("seed", "score")).select("id", "seed", f32("score"))


# partitionings -----------------------------------------------------------------------------

def _strategy(name, parts):
    def run(spark, d):
        edges = strategies.partition_by(chain(spark, d).edges, name, parts, "affine")
        return edges.select("edge_id", "src", "dst", long("part"))

    return run


# seeds and blocks --------------------------------------------------------------------------

def top_degree(spark, d):
    return top_degree_seeds(chain(spark, d).edges, SEEDS)


def spread(spark, d):
    return spread_seeds(chain(spark, d).edges, SEEDS).select("seed", "value", "rank")


def spread_limited(spark, d):
    """The walk through the first candidates alone: fewer seeds than asked for are found."""
    return spread_seeds(chain(spark, d).edges, SEEDS, candidates=2 * SEEDS).select("seed", "value", "rank")


def propagate(spark, d):
    scores = blocks.propagate(chain(spark, d), _seeds(spark, d), ROUNDS, TOPK)
    return blocks.seed_distances(scores).select("id", "seed", f32("score"))


def _few_scores(spark, d):
    """Two seeds and one round, so that many vertices stay unvisited."""
    graph = chain(spark, d)
    return once(spark, d, "few", lambda: cut(blocks.propagate(graph, top_degree_seeds(graph.edges, 2), 1, TOPK)))


def unvisited(spark, d):
    return blocks.coverage(chain(spark, d), _few_scores(spark, d))


def unvisited_vertices(spark, d):
    return blocks.unvisited_vertices(chain(spark, d), _few_scores(spark, d))


def edge_profiles(spark, d):
    profiles = blocks.edge_profiles(chain(spark, d), _scores(spark, d), TOPK)
    return blocks.edge_candidates(profiles).select("edge_id", long("rank"), "seed", f32("score"))


def assign_blocks(spark, d):
    return blocks.assign_blocks(_profiles(spark, d)).select("edge_id", "src", "dst", "block", f32("score"))


def block_sizes(spark, d):
    return blocks.block_sizes(_blocks(spark, d))


def block_representatives(spark, d):
    return blocks.block_representatives(_blocks(spark, d))


def edge_blocks(spark, d):
    """The flagship: from raw line items to the block of every co-purchase edge."""
    graph = chain(spark, d)
    seeds = top_degree_seeds(graph.edges, SEEDS)
    scores = blocks.propagate(graph, seeds, ROUNDS, TOPK)
    labels = blocks.assign_blocks(blocks.edge_profiles(graph, scores, TOPK))
    labels = cut(labels.select("edge_id", "src", "dst", "block"))
    sizes = blocks.block_sizes(labels, include_unassigned=True).withColumnRenamed("n_edges", "block_edges")
    return join_unique(labels, sizes, ["block"])


# balancing ---------------------------------------------------------------------------------

def _cap(spark, d):
    return balance.default_cap(_blocks(spark, d).count(), SEEDS)


def capped_assign(spark, d):
    return balance.capped_assign(_profiles(spark, d), _seeds(spark, d))


def partial_reschedule(spark, d):
    return balance.partial_reschedule(_profiles(spark, d), _seeds(spark, d))


def fill_residual(spark, d):
    labels = _blocks(spark, d).select("edge_id", "src", "dst", "block")
    return balance.fill_residual(labels, _seeds(spark, d), _cap(spark, d))


def _merge(spark, d):
    return balance.merge_blocks_lpt(blocks.block_sizes(_blocks(spark, d)), 4)


def lpt_merge(spark, d):
    return _merge(spark, d).select("block", long("part"))


def block_overlaps(spark, d):
    return balance.block_overlaps(balance.block_vertices(_blocks(spark, d)))


def initial_blocks(spark, d):
    sizes = blocks.block_sizes(_blocks(spark, d))
    members = balance.block_vertices(_blocks(spark, d))
    chosen = balance.pick_initial_blocks(sizes, members, balance.block_overlaps(members), 4, OVERLAP)
    return chosen.select("block", long("part"))


def overlap_merge(spark, d):
    sizes = blocks.block_sizes(_blocks(spark, d))
    merged = balance.merge_blocks_overlap(sizes, balance.block_vertices(_blocks(spark, d)), 4, OVERLAP)
    return merged.select("block", long("part"))


def _filled(spark, d):
    sizes = blocks.block_sizes(_blocks(spark, d))
    residual = _blocks(spark, d).filter("block = -1").count()
    return balance.water_fill(balance.part_sizes(sizes, _merge(spark, d)), residual)


def water_fill(spark, d):
    return _filled(spark, d).select(long("part"), "n_edges", "quota")


def materialize_partitions(spark, d):
    out = balance.materialize_partitions(_blocks(spark, d), _merge(spark, d), _filled(spark, d))
    return out.select("edge_id", "src", "dst", long("part"))


def balance_stats(spark, d):
    sizes = blocks.block_sizes(_blocks(spark, d))
    return balance.balance_stats(sizes).select("average", f32("sd"), f32("stddev_pop"), f32("sd_share"))


# metrics -----------------------------------------------------------------------------------

def replication_factor(spark, d):
    out = None
    for name in sorted(strategies.STRATEGIES):
        placed = strategies.partition_by(chain(spark, d).edges, name, PARTS, "affine")
        row = metrics.replication_factor(placed).select(F.lit(name).alias("strategy"), "replicas", "vertices", f32("factor"))
        out = row if out is None else out.unionByName(row)
    return out


def vertex_replicas(spark, d):
    return metrics.vertex_replicas(_placed(spark, d))


def edges_per_partition(spark, d):
    return metrics.edges_per_partition(_placed(spark, d)).select(long("part"), "n_edges")


def num_partitions(spark, d):
    return metrics.num_partitions(_blocks(spark, d), "block")


def visit_counts(spark, d):
    return metrics.visit_counts(_walks(spark, d))


def total_messages(spark, d):
    return metrics.total_messages(metrics.visit_counts(_walks(spark, d)), metrics.vertex_replicas(_placed(spark, d)))


def walks_by_source(spark, d):
    return metrics.walks_by_source(_walks(spark, d))


def walk_sources(spark, d):
    return metrics.walk_sources(_walks(spark, d)).select("id", "chunk", F.array_join("sources", ",").alias("sources"))


def cross_boundary_walks(spark, d):
    return metrics.cross_boundary_walks(_walks(spark, d), _placed(spark, d)).select(long("part"), "walks")


def visits_by_distance(spark, d):
    labels = _blocks(spark, d)
    visits = metrics.visit_counts(_walks(spark, d))
    out = metrics.visits_by_distance(visits, _scores(spark, d), labels, blocks.block_representatives(labels), 20, part="block")
    return out.select("part", "seed", "bin", f32("mean_visits"), "n")


def message_elements(spark, d):
    return ppr.message_elements(chain(spark, d), 3, delta=0.001, targets=_targets(spark, d)).select(long("round"), "elements")


# walks -------------------------------------------------------------------------------------

def indexed_neighbors(spark, d):
    return walks.indexed_neighbors(chain(spark, d).edges)


def random_neighbor(spark, d):
    graph = chain(spark, d)
    start = graph.vertices.select(F.col("id").alias("source"), F.lit(1).alias("walk"), F.col("id").alias("current"))
    return walks.random_neighbor(start, graph, mode="affine").select("source", "next")


def _as_text(df, *more):
    return df.select("source", long("walk"), F.array_join("path", ",").alias("path"), *more)


def walk_segments(spark, d):
    return _as_text(walks.walk_segments(chain(spark, d), SAMPLINGS, STEPS, mode="affine"), "current")


def full_walks(spark, d):
    return _as_text(walks.full_walks(chain(spark, d), SAMPLINGS, STEPS, mode="affine"))


def full_walks_next(spark, d):
    return _as_text(walks.full_walks(chain(spark, d), SAMPLINGS, STEPS, mode="affine", include_next=True))


def walk_ids(spark, d):
    return walks.walk_ids(chain(spark, d), SAMPLINGS, STEPS, mode="affine").select("source", long("walk"), "current")


def segments_by_source(spark, d):
    listed = walks.segments_by_source(_walks(spark, d), chain(spark, d).vertices)
    as_text = F.transform("segments", lambda s: F.concat_ws(":", s["walk"], F.array_join(s["path"], ",")))
    return listed.select("source", "chunk", F.array_join(as_text, "|").alias("segments"))


def hub_walks(spark, d):
    return walks.hub_walks(chain(spark, d), _seeds(spark, d), mode="affine")


def geometric_lengths(spark, d):
    """Walk lengths from a uniform number of each vertex."""
    u = (F.col("id") % 97 + F.lit(0.5)) / F.lit(97.0)
    return chain(spark, d).vertices.select("id", walks.geometric_length(u, 0.15).cast("long").alias("length"))


def static_pagerank(spark, d):
    return algorithms.static_pagerank(chain(spark, d), 3).select("id", f32("rank"))


# personalized PageRank and graph algorithms --------------------------------------------------

def _targets(spark, d):
    return _seeds(spark, d).select(F.col("seed").alias("id"))


def inverse_p_distance(spark, d):
    return ppr.inverse_p_distance(chain(spark, d), 2, targets=_targets(spark, d)).select("id", "target", f32("score"))


def ppr_with_length(spark, d):
    out = ppr.inverse_p_distance_with_length(chain(spark, d), 2, targets=_targets(spark, d))
    return out.select("id", "target", f32("score"), long("max_len"))


def ppr_doubling(spark, d):
    return ppr.inverse_p_distance_doubling(chain(spark, d), 2, targets=_targets(spark, d)).select("id", "target", f32("score"))


def ppr_doubling_recurrence(spark, d):
    return ppr.inverse_p_distance_doubling(chain(spark, d), 1, mode="recurrence", targets=_targets(spark, d)).select("id", "target", f32("score"))


def ppr_delta(spark, d):
    return ppr.ppr_delta(chain(spark, d), 3, targets=_targets(spark, d)).select("id", "target", f32("score"), f32("inc"))


def ppr_delta_converge(spark, d):
    return ppr.ppr_delta_converge(chain(spark, d), delta=0.001, targets=_targets(spark, d)).select("id", "target", f32("score"))


def _hub_ppr(rule):
    def run(spark, d):
        return ppr.hub_ppr(chain(spark, d), _seeds(spark, d), ROUNDS, rule=rule).select("id", "seed", f32("score"))

    return run


def ppr_lookup(spark, d):
    graph = chain(spark, d)
    best = top_degree_seeds(graph.edges, 1).select(F.col("seed").alias("id"))
    return ppr.inverse_p_distance_from(graph, best, 2).select("id", "target", f32("score"))


def pagerank(spark, d):
    return algorithms.pagerank(chain(spark, d), 5).select("id", f32("rank"))


def dynamic_pagerank(spark, d):
    return algorithms.dynamic_pagerank(chain(spark, d), PR_TOLERANCE).select("id", f32("rank"))


def connected_components(spark, d):
    return algorithms.connected_components(customer_orders(spark, d))


def triangle_count(spark, d):
    return algorithms.triangle_count(chain(spark, d))


def shortest_paths(spark, d):
    seeds = _seeds(spark, d).select(F.col("seed").alias("id"))
    marks = algorithms.pick_landmarks(seeds, LANDMARKS)
    return algorithms.shortest_paths(chain(spark, d), marks).select("id", "landmark", long("hops"))


# topics ------------------------------------------------------------------------------------

def topic_counts(spark, d):
    return topics.topic_counts(buyer_topics(spark, d))


def topic_authority(spark, d):
    return topics.topic_authority(topics.topic_counts(buyer_topics(spark, d))).select("id", "topic", f32("authority"))


def topic_similarity(spark, d):
    kinds = table(spark, d, "part").select("p_type").distinct()
    # similarity of two types by the share of their letters' count, a table derived from parts
    similar = kinds.select(
        F.col("p_type").alias("topic_a"), F.lit("PROMO").alias("topic_b"), (F.length("p_type") / 16.0).alias("value")
    ).filter(F.col("topic_a") != "LARGE")
    return topics.topic_similarity(topic_chain(spark, d).edges, "PROMO", similar).select("edge_id", f32("similarity"))


def topical_scores_from(spark, d):
    """Recommendations for the vertices of the targets list alone, by the forward form."""
    return topics.topical_scores_from(topic_chain(spark, d), "PROMO", _targets(spark, d), 3).select("id", "target", f32("score"))


def topical_scores(spark, d):
    return topics.topical_scores(topic_chain(spark, d), "PROMO", 2).select("id", "target", f32("score"))


QUERIES = {
    "edge_list_parse": edge_list_parse,
    "attr_edge_list_parse": attr_edge_list_parse,
    "labeled_edges": labeled_edges,
    "topic_edges": topic_edges,
    "seed_file": seed_file,
    "seed_distance_text": seed_distance_text,
    "block_representative_text": block_representative_text,
    "partition_files": partition_files,
    "partition_contents": partition_contents,
    "seed_round_trip": seed_round_trip,
    "flat_edge_files": flat_edge_files,
    "saved_vertices": saved_vertices,
    "vertex_sample": vertex_sample,
    "graph_counters": graph_counters,
    "static_pagerank": static_pagerank,
    "geometric_lengths": geometric_lengths,
    "graph_vertices": graph_vertices,
    "degrees": degrees,
    "neighbors": neighbors,
    "in_edges": in_edges,
    "triplets": triplets,
    "edge_weights": edge_weights,
    "mapped_graph": mapped_graph,
    "attach": attach,
    "union_with_defaults": union_with_defaults,
    "degree_join": degree_join,
    "edge_set_algebra": edge_set_algebra,
    "set_sizes": set_sizes,
    "top_edges": top_edges,
    "profile_entries": profile_entries,
    "per_partition": per_partition,
    "message_round": message_round,
    "map_functions": map_functions,
    "partition_1d": _strategy("edge_partition_1d", PARTS),
    "partition_2d": _strategy("edge_partition_2d", PARTS),
    "partition_2d_square": _strategy("edge_partition_2d", 9),
    "partition_rvc": _strategy("random_vertex_cut", PARTS),
    "partition_crvc": _strategy("canonical_random_vertex_cut", PARTS),
    "top_degree_seeds": top_degree,
    "spread_seeds": spread,
    "spread_seeds_limited": spread_limited,
    "propagate": propagate,
    "unvisited": unvisited,
    "unvisited_vertices": unvisited_vertices,
    "edge_profiles": edge_profiles,
    "assign_blocks": assign_blocks,
    "block_sizes": block_sizes,
    "block_representatives": block_representatives,
    "edge_blocks": edge_blocks,
    "capped_assign": capped_assign,
    "partial_reschedule": partial_reschedule,
    "fill_residual": fill_residual,
    "lpt_merge": lpt_merge,
    "block_overlaps": block_overlaps,
    "initial_blocks": initial_blocks,
    "overlap_merge": overlap_merge,
    "water_fill": water_fill,
    "materialize_partitions": materialize_partitions,
    "balance_stats": balance_stats,
    "replication_factor": replication_factor,
    "vertex_replicas": vertex_replicas,
    "edges_per_partition": edges_per_partition,
    "num_partitions": num_partitions,
    "visit_counts": visit_counts,
    "total_messages": total_messages,
    "walks_by_source": walks_by_source,
    "walk_sources": walk_sources,
    "cross_boundary_walks": cross_boundary_walks,
    "visits_by_distance": visits_by_distance,
    "message_elements": message_elements,
    "indexed_neighbors": indexed_neighbors,
    "random_neighbor": random_neighbor,
    "walk_segments": walk_segments,
    "full_walks": full_walks,
    "full_walks_next": full_walks_next,
    "walk_ids": walk_ids,
    "segments_by_source": segments_by_source,
    "hub_walks": hub_walks,
    "inverse_p_distance": inverse_p_distance,
    "ppr_with_length": ppr_with_length,
    "ppr_doubling": ppr_doubling,
    "ppr_doubling_recurrence": ppr_doubling_recurrence,
    "ppr_delta": ppr_delta,
    "ppr_delta_converge": ppr_delta_converge,
    "hub_ppr": _hub_ppr("reference"),
    "hub_ppr_sum": _hub_ppr("sum"),
    "ppr_lookup": ppr_lookup,
    "pagerank": pagerank,
    "dynamic_pagerank": dynamic_pagerank,
    "connected_components": connected_components,
    "triangle_count": triangle_count,
    "shortest_paths": shortest_paths,
    "topic_counts": topic_counts,
    "topic_authority": topic_authority,
    "topic_similarity": topic_similarity,
    "topical_scores": topical_scores,
    "topical_scores_from": topical_scores_from,
}


def entry(spark: SparkSession, d: str) -> DataFrame:
    return edge_blocks(spark, d)
