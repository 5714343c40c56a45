"""The same results in SQL, for an independent engine. Loops are unrolled into CTEs."""

from __future__ import annotations

from .queries import LANDMARKS, LENGTHS, OVERLAP, PARTS, PR_TOLERANCE, ROUNDS, SAMPLINGS, SEEDS, STEPS, TOPK
from .tables import ORDER_SHIFT

CHUNK = 10_000


def f32(expr: str) -> str:
    return f"CAST(CAST({expr} AS FLOAT) AS DOUBLE)"


class Sql:
    """A growing WITH list; ``out`` closes it."""

    def __init__(self):
        self.ctes: list[str] = []
        self.add("pairs", """SELECT src, dst FROM (
            SELECT l_partkey AS src,
                   lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst
            FROM lineitem) WHERE dst IS NOT NULL AND src <> dst""")
        self.add("e", "SELECT row_number() OVER (ORDER BY src, dst) AS edge_id, src, dst FROM pairs")
        self.add("v", "SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)")
        self.add("od", "SELECT src AS id, count(*) AS d FROM e GROUP BY src")
        self.add("ind", "SELECT dst AS id, count(*) AS d FROM e GROUP BY dst")
        self.add("ed", "SELECT e.*, od.d FROM e JOIN od ON od.id = e.src")

    def add(self, name: str, body: str) -> Sql:
        self.ctes.append(f"{name} AS MATERIALIZED ({body})")
        return self

    def recursive(self, head: str, body: str) -> Sql:
        self.ctes.append(f"{head} AS ({body})")
        return self

    def out(self, select: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(self.ctes) + "\n" + select


def seeded(sql: Sql, seeds: int = SEEDS) -> Sql:
    sql.add("deg", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id")
    return sql.add("seeds", f"SELECT id AS seed, 100000.0::DOUBLE AS value FROM deg ORDER BY degree DESC, id DESC LIMIT {seeds}")


UNIT = f"{1 << 93}::HUGEINT"  # blocks rank exact amounts, in whole parts of 1 / UNIT


def as_double(parts: str) -> str:
    """The double that an amount is ranked by: its four digits of 31 bits, smallest first."""
    digit = lambda k: f"(({parts}) // {1 << (31 * (3 - k))}::HUGEINT{f' % {1 << 31}' if k else ''})::DOUBLE / {1 << (31 * k)}::DOUBLE"
    return f"({digit(0)} + ({digit(1)} + ({digit(2)} + {digit(3)})))"


def scored(sql: Sql, seeds: int = SEEDS, rounds: int = ROUNDS) -> Sql:
    """Seed propagation: scores(id, seed, score)."""
    seeded(sql, seeds)
    sql.add("a0", f"SELECT seed AS id, seed, value::HUGEINT * {UNIT} AS parts, value AS score FROM seeds")
    sql.add("f0", "SELECT * FROM a0")
    for t in range(1, rounds + 1):
        p = t - 1
        sql.add(f"m{t}", f"""SELECT *, {as_double('parts')} AS score FROM (SELECT ed.dst AS id, f.seed, sum(f.parts // ed.d)::HUGEINT AS parts
            FROM f{p} f JOIN ed ON ed.src = f.id GROUP BY ed.dst, f.seed)""")
        sql.add(f"s{t}", f"""SELECT *, {as_double('parts')} AS score FROM (SELECT id, seed, sum(parts)::HUGEINT AS parts FROM
            (SELECT * FROM a{p} UNION ALL SELECT * FROM m{t}) GROUP BY id, seed)""")
        sql.add(f"a{t}", top(f"s{t}"))
        sql.add(f"f{t}", top(f"m{t}"))
    return sql.add("scores", f"SELECT id, seed, score FROM a{rounds}")


def spread_in_doubles(rounds: int = ROUNDS) -> Sql:
    """The same scores from plain doubles; sums that differ from the twelfth digit on are ties."""
    sql = seeded(Sql()).add("a0", "SELECT seed AS id, seed, value AS score FROM seeds").add("f0", "SELECT * FROM a0")
    best = lambda name: top(name).replace("ORDER BY score", "ORDER BY round(score, 8)")
    for t in range(1, rounds + 1):
        sql.add(f"m{t}", f"SELECT ed.dst AS id, f.seed, sum(f.score / ed.d) AS score FROM f{t - 1} f JOIN ed ON ed.src = f.id GROUP BY ed.dst, f.seed")
        sql.add(f"s{t}", f"SELECT id, seed, sum(score) AS score FROM (SELECT * FROM a{t - 1} UNION ALL SELECT * FROM m{t}) GROUP BY id, seed")
        sql.add(f"a{t}", best(f"s{t}")).add(f"f{t}", best(f"m{t}"))
    return sql


def top(name: str, keys: str = "id") -> str:
    return f"""SELECT * FROM {name} QUALIFY row_number() OVER
        (PARTITION BY {keys} ORDER BY score DESC, seed) <= {TOPK}"""


def profiled(sql: Sql) -> Sql:
    scored(sql)
    sql.add("ends", """SELECT e.edge_id, s.seed, sum(s.score) AS score FROM
        (SELECT edge_id, src AS id FROM e UNION ALL SELECT edge_id, dst FROM e) e
        JOIN scores s ON s.id = e.id GROUP BY e.edge_id, s.seed""")
    return sql.add("prof", f"""SELECT * FROM (SELECT *, row_number() OVER
        (PARTITION BY edge_id ORDER BY score DESC, seed) AS rank FROM ends) WHERE rank <= {TOPK}""")


def blocked(sql: Sql) -> Sql:
    profiled(sql)
    return sql.add("b", """SELECT e.edge_id, e.src, e.dst, coalesce(p.seed, -1) AS block, coalesce(p.score, 0.0) AS score
        FROM e LEFT JOIN (SELECT * FROM prof WHERE rank = 1) p ON p.edge_id = e.edge_id""")


def merged(sql: Sql) -> Sql:
    """Block sizes merged into four partitions, largest first to the least loaded."""
    blocked(sql)
    sql.add("sizes", """SELECT block, n, row_number() OVER (ORDER BY n DESC, block) AS i FROM
        (SELECT block, count(*) AS n FROM b WHERE block <> -1 GROUP BY block)""")
    sql.recursive("lpt(i, loads, block, part)", """
        SELECT 0::BIGINT, [0::BIGINT, 0, 0, 0], -1::BIGINT, -1::BIGINT
        UNION ALL
        SELECT s.i,
               list_transform(l.loads, lambda x, k: CASE WHEN k = list_position(l.loads, list_min(l.loads)) THEN x + s.n ELSE x END),
               s.block, (list_position(l.loads, list_min(l.loads)) - 1)::BIGINT
        FROM lpt l JOIN sizes s ON s.i = l.i + 1""")
    sql.add("merge", "SELECT block, part FROM lpt WHERE i > 0")
    sql.add("parts", "SELECT m.part, sum(s.n)::BIGINT AS n FROM merge m JOIN sizes s USING (block) GROUP BY m.part")
    sql.add("r", "SELECT count(*) AS r FROM b WHERE block = -1")
    sql.add("level", """SELECT max(l) AS l FROM (
        SELECT l, sum(greatest(0, l - n)) AS cost FROM
          (SELECT unnest(range(0, (SELECT count(*) + 1 FROM e))) AS l), parts GROUP BY l), r WHERE cost <= r""")
    sql.add("filled", "SELECT part, n, greatest(0, l - n)::BIGINT AS base FROM parts, level")
    return sql.add("quota", """SELECT part, n, base + CASE WHEN row_number() OVER (ORDER BY n, part) = 1
        THEN (SELECT r FROM r) - (SELECT sum(base) FROM filled) ELSE 0 END AS quota FROM filled""")


def refused(sql: Sql, cands: str, room: str, rounds: int = 40) -> Sql:
    """Capped assignment of ``cands(edge_id, rank, seed, key)`` under ``room(seed, room)``: edges
    propose to their best seed still open, overfull seeds raise their bar. Rounds after the
    outcome is stable change nothing. Ends in picks(edge_id, seed)."""
    sql.add("bar0", f"SELECT seed, 'inf'::DOUBLE AS bar, 0::BIGINT AS bar_edge FROM {room} WHERE room <= 0")
    for t in range(1, rounds + 1):
        sql.add(f"pick{t}", f"""SELECT c.edge_id, arg_min(c.seed, c.rank) AS seed, arg_min(c.key, c.rank) AS key
            FROM {cands} c LEFT JOIN bar{t - 1} b ON b.seed = c.seed
            WHERE b.bar IS NULL OR c.key > b.bar OR (c.key = b.bar AND c.edge_id <= b.bar_edge) GROUP BY c.edge_id""")
        sql.add(f"new{t}", f"""SELECT p.seed, p.key AS bar, p.edge_id AS bar_edge FROM
            (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY key DESC, edge_id) AS place,
                count(*) OVER (PARTITION BY seed) AS n FROM pick{t}) p
            JOIN {room} r ON r.seed = p.seed WHERE n > room AND place = room""")
        sql.add(f"bar{t}", f"""SELECT * FROM new{t} UNION ALL
            SELECT * FROM bar{t - 1} WHERE seed NOT IN (SELECT seed FROM new{t})""")
    return sql.add("picks", f"SELECT edge_id, seed FROM pick{rounds}")


def block_sets(sql: Sql) -> Sql:
    """bs(block, n, i, ids): blocks by size with their vertex lists."""
    blocked(sql)
    sql.add("bv", """SELECT DISTINCT block, id FROM
        (SELECT block, src AS id FROM b UNION ALL SELECT block, dst FROM b) WHERE block <> -1""")
    sql.add("sizes", "SELECT block, count(*) AS n FROM b WHERE block <> -1 GROUP BY block")
    return sql.add("bs", """SELECT block, n, row_number() OVER (ORDER BY n DESC, block) AS i, ids FROM sizes
        JOIN (SELECT block, list(id) AS ids FROM bv GROUP BY block) USING (block)""")


def opened(sql: Sql, parts: int = 4, share: float = OVERLAP) -> Sql:
    """The initial blocks: state after looking at i blocks; chosen blocks and their sets."""
    block_sets(sql)
    sql.recursive("o(i, chosen, sets, loads)", f"""
        SELECT 0::BIGINT, CAST([] AS BIGINT[]), CAST([] AS BIGINT[][]), CAST([] AS BIGINT[])
        UNION ALL
        SELECT bs.i,
          CASE WHEN ok THEN list_append(chosen, bs.block) ELSE chosen END,
          CASE WHEN ok THEN list_append(sets, bs.ids) ELSE sets END,
          CASE WHEN ok THEN list_append(loads, bs.n) ELSE loads END
        FROM (SELECT o.*, bs.block, bs.i AS bi, len(chosen) < {parts} AND len(list_filter(sets, lambda x:
                len(list_intersect(x, bs.ids)) > {share}::DOUBLE * least(len(x), len(bs.ids)))) = 0 AS ok
              FROM o JOIN bs ON bs.i = o.i + 1) s JOIN bs ON bs.i = s.bi""")
    return sql.add("start", "SELECT * FROM o ORDER BY i DESC LIMIT 1")


AFFINE = "({0} * 1000003 % 2147483647)"


def part_2d(parts: int) -> str:
    side = next(s for s in range(1, parts + 1) if s * s >= parts)
    src, dst = AFFINE.format("src"), AFFINE.format("dst")
    if side * side == parts:
        return f"({src} % {side}) * {side} + {dst} % {side}"
    rows = -(-parts // side)
    last = parts - rows * (side - 1)
    col = f"(({src} % {parts}) // {rows})"
    return f"{col} * {rows} + {dst} % (CASE WHEN {col} < {side - 1} THEN {rows} ELSE {last} END)"


def pair(a: str, b: str) -> str:
    return f"(({AFFINE.format(a)} * 31 + {AFFINE.format(b)}) % 2147483647)"


PART_OF = {
    "canonical_random_vertex_cut": lambda p: f"{pair('least(src, dst)', 'greatest(src, dst)')} % {p}",
    "edge_partition_1d": lambda p: f"{AFFINE.format('src')} % {p}",
    "edge_partition_2d": part_2d,
    "random_vertex_cut": lambda p: f"{pair('src', 'dst')} % {p}",
}


def placed(sql: Sql) -> Sql:
    sql.add("placed", f"SELECT edge_id, src, dst, CAST({part_2d(PARTS)} AS BIGINT) AS part FROM e")
    return sql.add("pv", "SELECT DISTINCT part, id FROM (SELECT part, src AS id FROM placed UNION ALL SELECT part, dst FROM placed)")


def draw(step: int) -> str:
    return f"(w.source * 1000003 + w.walk * 7919 + {step} * 104729 + w.current * 31 + 7)"


def walked(sql: Sql, steps: int = STEPS) -> Sql:
    """walks(source, walk, current, path, stopped)."""
    sql.add("nb", """SELECT e.src, row_number() OVER (PARTITION BY e.src ORDER BY e.dst, e.edge_id) - 1 AS idx, e.dst, od.d
        FROM e JOIN od ON od.id = e.src""")
    sql.add("w0", f"""SELECT id AS source, k::BIGINT AS walk, id AS current, CAST([] AS BIGINT[]) AS path, false AS stopped
        FROM v, (SELECT unnest(range(1, {SAMPLINGS + 1})) AS k)""")
    for t in range(1, steps + 1):
        sql.add(f"w{t}", f"""SELECT w.source, w.walk, coalesce(nb.dst, w.current) AS current,
              CASE WHEN nb.dst IS NULL THEN w.path ELSE list_append(w.path, nb.dst) END AS path, nb.dst IS NULL AS stopped
            FROM w{t - 1} w LEFT JOIN od ON od.id = w.current
            LEFT JOIN nb ON nb.src = w.current AND nb.idx = {draw(t)} % od.d""")
    return sql.add("walks", f"SELECT * FROM w{steps}")


def visited(sql: Sql) -> Sql:
    walked(sql)
    return sql.add("visits", "SELECT id, count(*) AS visits FROM (SELECT unnest(path) AS id FROM walks) GROUP BY id")


def one_hop(sql: Sql, extra: str = "") -> Sql:
    """Direct scores towards the seeds."""
    seeded(sql)
    return sql.add("p0", f"""SELECT src AS id, dst AS target, sum(0.15 / d) AS score {extra} FROM ed
        WHERE dst IN (SELECT seed FROM seeds) GROUP BY src, dst""")


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    # sources
    o["edge_list_parse"] = Sql().out("SELECT src, dst FROM e")
    o["attr_edge_list_parse"] = Sql().out("SELECT src, 't' || (src % 7) AS attr, dst FROM e")
    o["labeled_edges"] = Sql().out("""SELECT replace(a.p_name, ' ', '_') AS src_name, 't' || (src % 3) AS attr,
        replace(b.p_name, ' ', '_') AS dst_name FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst""")
    buyers = """buyers AS (SELECT o_custkey AS src, l_suppkey + 1000000 AS dst, list_sort(list(DISTINCT p_type)) AS topics
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
    o["topic_edges"] = f"""WITH {buyers} SELECT src, dst, array_to_string(topics, '|') AS topics,
        len(topics)::BIGINT AS n_topics FROM buyers"""
    o["seed_file"] = Sql().out("SELECT id AS seed, CASE WHEN id % 2 = 0 THEN id * 2.5 ELSE 100000.0 END::DOUBLE AS value FROM v")
    o["seed_distance_text"] = Sql().out("SELECT src AS id, dst AS seed, (dst * 1.5)::DOUBLE AS score FROM e")
    o["block_representative_text"] = Sql().out("""SELECT src, dst, src % 50 AS seed FROM e
        QUALIFY row_number() OVER (PARTITION BY src % 50 ORDER BY src, dst) = 1""")
    o["partition_files"] = placed(Sql()).out("SELECT src, dst, part FROM placed")
    o["partition_contents"] = placed(Sql()).out(f"""SELECT part, chunk, string_agg(src || '-' || dst, ',' ORDER BY src, dst) AS contents
        FROM (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY src, dst) - 1) // {CHUNK} AS chunk
        FROM (SELECT DISTINCT part, src, dst FROM placed)) GROUP BY 1, 2""")
    o["seed_round_trip"] = seeded(Sql()).out("SELECT seed, value, row_number() OVER (ORDER BY seed) - 1 AS rank FROM seeds")
    o["flat_edge_files"] = Sql().out("SELECT count(*) AS n, sum(src)::BIGINT AS src, sum(dst)::BIGINT AS dst FROM e GROUP BY src % 3")
    o["saved_vertices"] = Sql().out("""SELECT v.id, coalesce(od.d, 0)::BIGINT AS out_degree, coalesce(ind.d, 0)::BIGINT AS in_degree,
        (coalesce(od.d, 0) + coalesce(ind.d, 0))::BIGINT AS degree FROM v LEFT JOIN od ON od.id = v.id LEFT JOIN ind ON ind.id = v.id""")
    o["vertex_sample"] = "SELECT true AS is_subset, true AS near_a_tenth"
    o["graph_counters"] = Sql().out("""SELECT 'edges' AS counter, count(*)::BIGINT AS value FROM e UNION ALL SELECT 'loops', count(*) FILTER (src = dst) FROM e
        UNION ALL SELECT 'src_sum', sum(src)::BIGINT FROM e UNION ALL SELECT 'dst_sum', sum(dst)::BIGINT FROM e
        UNION ALL SELECT 'vertices', count(*) FROM v UNION ALL SELECT 'id_sum', sum(id)::BIGINT FROM v""")
    o["geometric_lengths"] = Sql().out("""SELECT id, greatest(1, ceil(ln(1.0::DOUBLE - (id % 97 + 0.5::DOUBLE) / 97.0::DOUBLE)
        / ln(1.0::DOUBLE - 0.15::DOUBLE)))::BIGINT AS length FROM v""")
    # graph building blocks
    o["graph_vertices"] = Sql().add("given", """SELECT s_suppkey + 500000 AS id, s_nationkey::BIGINT AS n FROM supplier
        UNION ALL SELECT p_partkey, p_size::BIGINT FROM part""").out("""SELECT id, coalesce(n, -5)::BIGINT AS n FROM
        (SELECT id FROM v UNION SELECT id FROM given) LEFT JOIN given USING (id)""")
    o["degrees"] = Sql().out("""SELECT v.id, coalesce(od.d, 0)::BIGINT AS out_degree, coalesce(ind.d, 0)::BIGINT AS in_degree,
        (coalesce(od.d, 0) + coalesce(ind.d, 0))::BIGINT AS degree FROM v LEFT JOIN od ON od.id = v.id LEFT JOIN ind ON ind.id = v.id""")
    o["neighbors"] = Sql().out(f"""SELECT id, chunk, direction, string_agg(other::VARCHAR, ',' ORDER BY other) AS ids FROM
        (SELECT *, (row_number() OVER (PARTITION BY direction, id ORDER BY other) - 1) // {CHUNK} AS chunk FROM
        (SELECT src AS id, dst AS other, 'out' AS direction FROM e UNION ALL SELECT dst, src, 'in' FROM e)) GROUP BY 1, 2, 3""")
    o["in_edges"] = Sql().out(f"""SELECT id, chunk, string_agg(edge_id || ':' || src, ',' ORDER BY edge_id) AS edges FROM
        (SELECT dst AS id, edge_id, src, (row_number() OVER (PARTITION BY dst ORDER BY edge_id) - 1) // {CHUNK} AS chunk FROM e)
        GROUP BY 1, 2""")
    ends = """SELECT e.edge_id, e.src, e.dst, coalesce(a.d, 0)::BIGINT AS src_degree, coalesce(z.d, 0)::BIGINT AS dst_degree
        FROM e LEFT JOIN od a ON a.id = e.src LEFT JOIN od z ON z.id = e.dst"""
    o["triplets"] = Sql().out(ends)
    o["edge_weights"] = Sql().add("t", ends).out(f"SELECT edge_id, src, dst, {f32('1.0 / src_degree')} AS weight FROM t WHERE 1.0 / src_degree < 0.5")
    o["mapped_graph"] = Sql().out("""SELECT od.id, (od.d * 2)::BIGINT AS twice, sum(abs(e.src - e.dst))::BIGINT AS spans
        FROM od JOIN e ON e.src = od.id WHERE od.d * 2 > 20 GROUP BY 1, 2""")
    o["attach"] = Sql().out("SELECT v.id, coalesce(od.d, 0)::BIGINT AS degree FROM v LEFT JOIN od ON od.id = v.id")
    o["union_with_defaults"] = Sql().out("""SELECT v.id, coalesce(m.best, -1) AS best FROM v
        LEFT JOIN (SELECT src AS id, max(dst) AS best FROM e GROUP BY src) m ON m.id = v.id""")
    o["degree_join"] = Sql().out("SELECT od.id, od.d AS outs, ind.d AS ins FROM od JOIN ind ON od.id = ind.id")
    o["edge_set_algebra"] = seeded(Sql()).add("kept", "SELECT edge_id, src, dst FROM e WHERE src NOT IN (SELECT seed FROM seeds)").out(
        "SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE dst IN (SELECT seed FROM seeds)")
    o["set_sizes"] = placed(Sql()).out("""SELECT
        (SELECT count(*) FROM (SELECT id FROM pv WHERE part = 0 INTERSECT SELECT id FROM pv WHERE part = 1)) AS shared,
        (SELECT count(*) FROM (SELECT id FROM pv WHERE part = 0 UNION SELECT id FROM pv WHERE part = 1)) AS united""")
    o["top_edges"] = Sql().add("t", ends).out("""SELECT edge_id, src_degree * dst_degree AS reach FROM t
        ORDER BY reach DESC, edge_id LIMIT 50""")
    o["profile_entries"] = profiled(Sql()).out(f"""SELECT edge_id, seed, {f32('score')} AS score FROM prof
        UNION ALL SELECT edge_id, -1, 0.0 FROM e""")
    o["per_partition"] = placed(Sql()).out("SELECT part, count(*) AS n, min(src) AS low, max(dst) AS high FROM placed GROUP BY part")
    o["message_round"] = Sql().out("""SELECT l.other AS id, min(l.at) AS low, sum(od.d)::BIGINT AS total FROM
        (SELECT src AS at, dst AS other FROM e UNION ALL SELECT dst, src FROM e) l JOIN od ON od.id = l.at WHERE od.d > 2 GROUP BY 1""")
    o["map_functions"] = scored(Sql()).out(f"SELECT id, seed, {f32('(score + score) / 4.0')} AS score FROM scores WHERE seed <> id")
    # partitionings
    for name, kind, parts in [
        ("partition_1d", "edge_partition_1d", PARTS), ("partition_2d", "edge_partition_2d", PARTS),
        ("partition_2d_square", "edge_partition_2d", 9), ("partition_rvc", "random_vertex_cut", PARTS),
        ("partition_crvc", "canonical_random_vertex_cut", PARTS),
    ]:
        o[name] = Sql().out(f"SELECT edge_id, src, dst, CAST({PART_OF[kind](parts)} AS BIGINT) AS part FROM e")
    # seeds and blocks
    o["top_degree_seeds"] = seeded(Sql()).out("SELECT seed, value FROM seeds")
    o["propagate"] = spread_in_doubles().out(f"SELECT id, seed, {f32('score')} AS score FROM a{ROUNDS}")
    o["unvisited"] = scored(Sql(), 2, 1).add("hit", "SELECT DISTINCT id FROM scores").out("""
        SELECT 'vertices' AS kind, (SELECT count(*) FROM v WHERE id NOT IN (SELECT id FROM hit)) AS n
        UNION ALL SELECT 'edges', (SELECT count(*) FROM e WHERE src NOT IN (SELECT id FROM hit) AND dst NOT IN (SELECT id FROM hit))""")
    o["unvisited_vertices"] = scored(Sql(), 2, 1).out("SELECT id FROM v WHERE id NOT IN (SELECT id FROM scores)")
    o["edge_profiles"] = profiled(Sql()).out(f"SELECT edge_id, rank, seed, {f32('score')} AS score FROM prof")
    o["assign_blocks"] = blocked(Sql()).out(f"SELECT edge_id, src, dst, block, {f32('score')} AS score FROM b")
    o["block_sizes"] = blocked(Sql()).out("SELECT block, count(*) AS n_edges FROM b WHERE block <> -1 GROUP BY block")
    o["block_representatives"] = blocked(Sql()).out("""SELECT src, dst, block AS seed FROM b
        QUALIFY row_number() OVER (PARTITION BY block ORDER BY src, dst) = 1""")
    o["edge_blocks"] = blocked(Sql()).out("SELECT edge_id, src, dst, block, count(*) OVER (PARTITION BY block) AS block_edges FROM b")
    o["spread_seeds"] = seeded(Sql()).add("ranked", """SELECT id, row_number() OVER (ORDER BY degree DESC, id DESC) AS rank FROM deg""").add(
        "near", "SELECT id, list(other) AS ids FROM (SELECT src AS id, dst AS other FROM e UNION ALL SELECT dst, src FROM e) GROUP BY id").recursive(
        "scan(i, taken, ranks)", f"""SELECT 0::BIGINT, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL
        SELECT r.rank, CASE WHEN list_has_any(taken, near.ids) THEN taken ELSE list_append(taken, r.id) END,
          CASE WHEN list_has_any(taken, near.ids) THEN ranks ELSE list_append(ranks, r.rank) END
        FROM scan JOIN ranked r ON r.rank = scan.i + 1 JOIN near ON near.id = r.id WHERE len(taken) < {SEEDS}""").out("""
        SELECT unnest(taken) AS seed, 100000.0::DOUBLE AS value, unnest(ranks) AS rank FROM (SELECT * FROM scan ORDER BY i DESC LIMIT 1)""")
    o["spread_seeds_limited"] = o["spread_seeds"].replace("AS rank FROM deg)", f"AS rank FROM deg QUALIFY rank <= {2 * SEEDS})")
    # balancing
    cands = "SELECT edge_id, rank, seed, score AS key FROM prof"
    room = f"SELECT seed, (SELECT count(*) FROM e) // {SEEDS} + 1 AS room FROM seeds"
    o["capped_assign"] = refused(profiled(Sql()).add("c", cands).add("room", room), "c", "room").out("""
        SELECT e.edge_id, e.src, e.dst, coalesce(p.seed, -1) AS block FROM e LEFT JOIN picks p ON p.edge_id = e.edge_id""")
    sql = profiled(Sql()).add("c", cands).add("room", room).add("kept", """SELECT edge_id, seed FROM
        (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY key DESC, edge_id) AS place FROM c WHERE rank = 1)
        WHERE place <= floor((SELECT max(room) FROM room) * (1 - 0.1::DOUBLE))""")
    sql.add("c2", "SELECT * FROM c WHERE edge_id NOT IN (SELECT edge_id FROM kept)")
    sql.add("room2", "SELECT seed, room - coalesce(n, 0) AS room FROM room LEFT JOIN (SELECT seed, count(*) AS n FROM kept GROUP BY seed) USING (seed)")
    o["partial_reschedule"] = refused(sql, "c2", "room2").out("""SELECT e.edge_id, e.src, e.dst, coalesce(k.seed, p.seed, -1) AS block
        FROM e LEFT JOIN kept k ON k.edge_id = e.edge_id LEFT JOIN picks p ON p.edge_id = e.edge_id""")
    o["initial_blocks"] = opened(Sql()).out("""SELECT unnest(chosen) AS block,
        unnest(range(0, len(chosen)))::BIGINT AS part FROM start""")
    o["overlap_merge"] = opened(Sql()).recursive("g(k, sets, loads, open, block, part)", """
        SELECT 0, sets, loads, list_filter((SELECT list(block) FROM bs), lambda x: NOT list_contains(chosen, x)), -1::BIGINT, -1::BIGINT FROM start
        UNION ALL
        (SELECT k + 1,
          list_transform(sets, lambda x, j: CASE WHEN j = p THEN list_distinct(list_concat(x, ids)) ELSE x END),
          list_transform(loads, lambda x, j: CASE WHEN j = p THEN x + n ELSE x END),
          list_filter(open, lambda x: x <> bl), bl, (p - 1)::BIGINT
        FROM (SELECT g.k, g.sets, g.loads, g.open, bs.block AS bl, bs.ids, bs.n, list_position(g.loads, list_min(g.loads)) AS p
              FROM g JOIN bs ON list_contains(g.open, bs.block)) s
        ORDER BY len(list_intersect(sets[p], ids)) DESC, n DESC, bl LIMIT 1)""").out("""
        SELECT block, part FROM g WHERE k > 0
        UNION ALL SELECT unnest(chosen), unnest(range(0, len(chosen)))::BIGINT FROM start""")
    o["fill_residual"] = blocked(Sql()).add("free", f"""SELECT seed, greatest(0, (SELECT count(*) FROM e) // {SEEDS} + 1 - coalesce(n, 0)) AS free
        FROM seeds LEFT JOIN (SELECT block AS seed, count(*) AS n FROM b GROUP BY block) USING (seed)""").add(
        "slots", "SELECT seed, sum(free) OVER (ORDER BY seed) - free AS lo, sum(free) OVER (ORDER BY seed) AS hi FROM free").add(
        "rest", "SELECT *, row_number() OVER (ORDER BY edge_id) - 1 AS n FROM b WHERE block = -1").out("""
        SELECT edge_id, src, dst, block FROM b WHERE block <> -1 UNION ALL
        SELECT edge_id, src, dst, coalesce(seed, -1) FROM rest LEFT JOIN slots ON n >= lo AND n < hi""")
    o["lpt_merge"] = merged(Sql()).out("SELECT block, part FROM merge")
    o["block_overlaps"] = blocked(Sql()).add("bv", """SELECT DISTINCT block, id FROM
        (SELECT block, src AS id FROM b UNION ALL SELECT block, dst FROM b) WHERE block <> -1""").out("""
        SELECT x.block AS a, y.block AS b, count(*) AS shared FROM bv x JOIN bv y ON x.id = y.id AND x.block < y.block GROUP BY 1, 2""")
    o["water_fill"] = merged(Sql()).out("SELECT part, n AS n_edges, quota::BIGINT AS quota FROM quota")
    o["materialize_partitions"] = merged(Sql()).add(
        "slots", "SELECT part, sum(quota) OVER (ORDER BY part) - quota AS lo, sum(quota) OVER (ORDER BY part) AS hi FROM quota").add(
        "rest", "SELECT *, row_number() OVER (ORDER BY edge_id) - 1 AS n FROM b WHERE block = -1").out("""
        SELECT edge_id, src, dst, part FROM b JOIN merge USING (block) UNION ALL
        SELECT edge_id, src, dst, part FROM rest JOIN slots ON n >= lo AND n < hi""")
    o["balance_stats"] = merged(Sql()).add("g", "SELECT (sum(n) // count(*))::BIGINT AS average FROM sizes").add(
        "s", """SELECT average, sqrt((sum((n - average) * (n - average)) // count(*))::DOUBLE) AS sd, stddev_pop(n) AS sp
        FROM sizes, g GROUP BY average""").out(
        f"SELECT average, {f32('sd')} AS sd, {f32('sp')} AS stddev_pop, {f32('sd / average')} AS sd_share FROM s")
    # metrics
    factors = []
    for name in sorted(PART_OF):
        factors.append(f"""SELECT '{name}' AS strategy, count(*) AS replicas, count(DISTINCT id) AS vertices,
            {f32('count(*) / count(DISTINCT id)')} AS factor FROM (SELECT DISTINCT part, id FROM (
            SELECT {PART_OF[name](PARTS)} AS part, src AS id FROM e UNION ALL SELECT {PART_OF[name](PARTS)}, dst FROM e))""")
    o["replication_factor"] = Sql().out(" UNION ALL ".join(factors))
    o["vertex_replicas"] = placed(Sql()).out("SELECT id, count(*) AS replicas FROM pv GROUP BY id")
    o["edges_per_partition"] = placed(Sql()).out("SELECT part, count(*) AS n_edges FROM placed GROUP BY part")
    o["num_partitions"] = blocked(Sql()).out("SELECT count(DISTINCT block) AS n_parts FROM b")
    o["visit_counts"] = visited(Sql()).out("SELECT id, visits FROM visits")
    o["total_messages"] = visited(placed(Sql())).out("""SELECT sum(visits * n)::BIGINT AS messages FROM visits
        JOIN (SELECT id, count(*) AS n FROM pv GROUP BY id) USING (id)""")
    o["walks_by_source"] = walked(Sql()).out("SELECT current AS id, source, count(*) AS n FROM walks GROUP BY 1, 2")
    o["walk_sources"] = walked(Sql()).out(f"""SELECT id, chunk, string_agg(source::VARCHAR, ',' ORDER BY source, walk) AS sources FROM
        (SELECT current AS id, source, walk,
          (row_number() OVER (PARTITION BY current ORDER BY source, walk) - 1) // {CHUNK} AS chunk FROM walks) GROUP BY 1, 2""")
    o["cross_boundary_walks"] = walked(placed(Sql())).out("""SELECT p.part, count(*) AS walks FROM
        (SELECT part, src AS id FROM placed UNION ALL SELECT part, dst FROM placed) p JOIN walks w ON w.current = p.id
        WHERE NOT EXISTS (SELECT 1 FROM pv WHERE pv.part = p.part AND pv.id = w.source) GROUP BY p.part""")
    o["visits_by_distance"] = visited(blocked(Sql())).add("bv", """SELECT DISTINCT block, id FROM
        (SELECT block, src AS id FROM b UNION ALL SELECT block, dst FROM b) WHERE block <> -1""").add("r", """
        SELECT bv.block AS part, bv.block AS seed, visits, row_number() OVER (PARTITION BY bv.block ORDER BY coalesce(s.score, 0.0) DESC, bv.id) AS k,
          greatest(1, count(*) OVER (PARTITION BY bv.block) // 20) AS width
        FROM bv JOIN visits ON visits.id = bv.id LEFT JOIN scores s ON s.id = bv.id AND s.seed = bv.block""").out(
        f"SELECT part, seed, ((k - 1) // width)::BIGINT AS bin, {f32('avg(visits)')} AS mean_visits, count(*) AS n FROM r GROUP BY 1, 2, 3")
    # walks
    o["indexed_neighbors"] = Sql().out("""SELECT e.src, row_number() OVER (PARTITION BY e.src ORDER BY e.dst, e.edge_id) - 1 AS idx,
        e.dst, od.d AS outdeg FROM e JOIN od ON od.id = e.src""")
    o["random_neighbor"] = walked(Sql(), 1).out("SELECT source, CASE WHEN stopped THEN -1 ELSE current END AS next FROM walks WHERE walk = 1")
    text = "array_to_string(path, ',')"
    o["walk_segments"] = walked(Sql()).out(f"SELECT source, walk, {text} AS path, current FROM walks")
    o["full_walks"] = walked(Sql()).out(f"SELECT source, walk, array_to_string(CASE WHEN stopped THEN list_append(path, -1) ELSE path END, ',') AS path FROM walks")
    o["full_walks_next"] = walked(Sql(), STEPS + 1).out(f"SELECT source, walk, array_to_string(CASE WHEN stopped THEN list_append(path, -1) ELSE path END, ',') AS path FROM walks")
    o["walk_ids"] = walked(Sql()).out("SELECT source, walk, current FROM walks")
    o["segments_by_source"] = walked(Sql()).out(f"""SELECT source, (walk - 1) // {CHUNK} AS chunk,
        string_agg(walk || ':' || {text}, '|' ORDER BY walk) AS segments FROM walks GROUP BY 1, 2""")
    hubs = seeded(Sql()).add("nb", """SELECT e.src, row_number() OVER (PARTITION BY e.src ORDER BY e.dst, e.edge_id) - 1 AS idx, e.dst, od.d
        FROM e JOIN od ON od.id = e.src""").add("h0", f"""SELECT seed AS source, k::BIGINT AS walk, len AS remaining, seed AS current
        FROM seeds, (VALUES {', '.join(f'({i}, {n})' for i, n in enumerate(LENGTHS, 1))}) t(k, len)""")
    for t in range(1, max(LENGTHS) + 1):
        hubs.add(f"h{t}", f"""SELECT w.source, w.walk, w.remaining - 1 AS remaining, nb.dst AS current FROM h{t - 1} w
            JOIN od ON od.id = w.current JOIN nb ON nb.src = w.current AND nb.idx = {draw(t)} % od.d WHERE w.remaining > 0""")
    arrivals = " UNION ALL ".join(f"SELECT current, source FROM h{t}" for t in range(max(LENGTHS) + 1))
    o["hub_walks"] = hubs.out(f"SELECT current AS id, source AS hub, count(*) AS n FROM ({arrivals}) GROUP BY 1, 2")
    # personalized PageRank
    sql = one_hop(Sql())
    for t in (1, 2):
        sql.add(f"p{t}", f"""SELECT id, target, sum(score) AS score FROM (
            SELECT ed.src AS id, p.target, p.score * (0.15 / ed.d) AS score FROM p{t - 1} p JOIN ed ON ed.dst = p.id
            UNION ALL SELECT * FROM p0) GROUP BY id, target""")
    o["inverse_p_distance"] = sql.out(f"SELECT id, target, {f32('score')} AS score FROM p2")
    sql = seeded(Sql(), 1).add("g0", "SELECT seed AS id, 1.0::DOUBLE AS w FROM seeds")
    for t in (1, 2, 3):
        sql.add(f"g{t}", f"SELECT ed.dst AS id, sum(g.w * (0.15 / ed.d)) AS w FROM g{t - 1} g JOIN ed ON ed.src = g.id GROUP BY ed.dst")
    o["ppr_lookup"] = sql.out(f"""SELECT seed AS id, id AS target, {f32('sum(w)')} AS score FROM
        (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3), seeds GROUP BY 1, 2""")
    sql = one_hop(Sql(), ", 1::BIGINT AS max_len")
    for t in (1, 2):
        sql.add(f"p{t}", f"""SELECT id, target, sum(score) AS score, max(max_len) AS max_len FROM (
            SELECT ed.src AS id, p.target, p.score * (0.15 / ed.d) AS score, p.max_len + 1 AS max_len FROM p{t - 1} p JOIN ed ON ed.dst = p.id
            UNION ALL SELECT * FROM p0) GROUP BY id, target""")
    o["ppr_with_length"] = sql.out(f"SELECT id, target, {f32('score')} AS score, max_len FROM p2")
    # doubling is checked against the plain depth-4 recursion
    sql = one_hop(Sql())
    for t in (1, 2, 3):
        sql.add(f"p{t}", f"""SELECT id, target, sum(score) AS score FROM (
            SELECT ed.src AS id, p.target, p.score * (0.15 / ed.d) AS score FROM p{t - 1} p JOIN ed ON ed.dst = p.id
            UNION ALL SELECT * FROM p0) GROUP BY id, target""")
    o["ppr_doubling"] = sql.out(f"SELECT id, target, {f32('score')} AS score FROM p3")
    o["ppr_doubling_recurrence"] = one_hop(Sql()).add("hop", "SELECT src AS id, dst AS target, sum(0.15 / d) AS score FROM ed GROUP BY src, dst").out(
        f"""SELECT id, target, {f32('sum(score)')} AS score FROM (
        SELECT * FROM p0 UNION ALL SELECT a.id, b.target, a.score * b.score FROM hop a JOIN p0 b ON a.target = b.id) GROUP BY 1, 2""")

    def increments(rounds: int) -> Sql:
        sql = one_hop(Sql()).add("q0", "SELECT id, target, score, score AS inc FROM p0")
        for t in range(1, rounds + 1):
            sql.add(f"q{t}", f"""SELECT id, target, sum(score) + sum(inc) AS score, sum(inc) AS inc FROM (
                SELECT ed.src AS id, q.target, 0.0::DOUBLE AS score, q.inc * (0.15 / ed.d) AS inc FROM q{t - 1} q
                JOIN ed ON ed.dst = q.id WHERE q.inc > 0.001
                UNION ALL SELECT id, target, score, 0.0 FROM q{t - 1}) GROUP BY id, target""")
        return sql

    o["ppr_delta"] = increments(3).out(f"SELECT id, target, {f32('score')} AS score, {f32('inc')} AS inc FROM q3")
    # 0.15^4 is below the threshold: further rounds change nothing
    o["ppr_delta_converge"] = increments(5).out(f"SELECT id, target, {f32('score')} AS score FROM q5")
    o["message_elements"] = increments(2).out(" UNION ALL ".join(
        f"SELECT {t + 1}::BIGINT AS round, coalesce(sum(n), 0)::BIGINT AS elements FROM (SELECT ind.d AS n FROM q{t} q JOIN ind ON ind.id = q.id WHERE q.inc > 0.001)"
        for t in range(3)))
    for name, old in (("hub_ppr", "0.15"), ("hub_ppr_sum", "1.0")):
        sql = seeded(Sql()).add("a0", "SELECT seed AS id, seed, value AS score, value AS inc FROM seeds")
        for t in range(1, ROUNDS + 1):
            sql.add(f"m{t}", f"""SELECT ed.dst AS id, a.seed, sum(a.inc * 0.85 / ed.d) AS inc FROM a{t - 1} a
                JOIN ed ON ed.src = a.id WHERE a.inc IS NOT NULL GROUP BY ed.dst, a.seed""")
            sql.add(f"a{t}", f"""SELECT coalesce(a.id, m.id) AS id, coalesce(a.seed, m.seed) AS seed,
                CASE WHEN m.inc IS NULL THEN a.score ELSE coalesce(a.score, 0) * {old}::DOUBLE + m.inc END AS score, m.inc AS inc
                FROM a{t - 1} a FULL JOIN m{t} m ON m.id = a.id AND m.seed = a.seed""")
        o[name] = sql.out(f"SELECT id, seed, {f32('score')} AS score FROM a{ROUNDS}")
    # PageRank and structure
    sql = Sql().add("r0", "SELECT id, 0.15::DOUBLE AS rank FROM v")
    for t in range(1, 6):
        sql.add(f"r{t}", f"""SELECT v.id, 0.15 + 0.85 * coalesce(m.s, 0) AS rank FROM v LEFT JOIN
            (SELECT ed.dst AS id, sum(r.rank / ed.d) AS s FROM r{t - 1} r JOIN ed ON ed.src = r.id GROUP BY ed.dst) m ON m.id = v.id""")
    o["static_pagerank"] = sql.out(f"SELECT id, {f32('rank')} AS rank FROM r3")
    o["pagerank"] = sql.out(f"SELECT id, {f32('rank')} AS rank FROM r5")
    sql = Sql().add("r0", "SELECT id, 0.15::DOUBLE AS rank, 0.15::DOUBLE AS delta FROM v")
    for t in range(1, 41):
        sql.add(f"r{t}", f"""SELECT r.id, r.rank + 0.85 * coalesce(m.s, 0) AS rank, 0.85 * coalesce(m.s, 0) AS delta FROM r{t - 1} r LEFT JOIN
            (SELECT ed.dst AS id, sum(r.delta / ed.d) AS s FROM r{t - 1} r JOIN ed ON ed.src = r.id WHERE r.delta > {PR_TOLERANCE} GROUP BY ed.dst) m
            ON m.id = r.id""")
    o["dynamic_pagerank"] = sql.out(f"SELECT id, {f32('rank')} AS rank FROM r40")
    o["connected_components"] = Sql().add("l", f"""SELECT o_custkey AS x, o_orderkey + {ORDER_SHIFT} AS y FROM orders
        UNION SELECT o_orderkey + {ORDER_SHIFT}, o_custkey FROM orders""").recursive(
        "reach(id, seen)", "SELECT x, x FROM l UNION SELECT l.y, r.seen FROM reach r JOIN l ON l.x = r.id").out(
        "SELECT id, min(seen) AS component FROM reach GROUP BY id")
    o["triangle_count"] = Sql().add("u", "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e").add(
        "t", "SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b").out("""
        SELECT v.id, coalesce(n, 0)::BIGINT AS triangles FROM v LEFT JOIN (SELECT id, count(*) AS n FROM
        (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id) USING (id)""")
    o["shortest_paths"] = seeded(Sql()).recursive("d(id, landmark, hops)", f"""
        SELECT seed, seed, 0::BIGINT FROM (SELECT seed FROM seeds ORDER BY seed LIMIT {LANDMARKS})
        UNION SELECT e.src, d.landmark, d.hops + 1 FROM d JOIN e ON e.dst = d.id WHERE d.hops < 60""").out(
        "SELECT id, landmark, min(hops) AS hops FROM d GROUP BY 1, 2")
    # topics
    counts = """c AS (SELECT id, topic, count(*) AS n FROM (SELECT dst AS id, unnest(topics) AS topic FROM buyers) GROUP BY 1, 2),
        m AS (SELECT *, max(n) OVER (PARTITION BY id) AS n_max FROM c)"""
    o["topic_counts"] = f"WITH {buyers}, {counts} SELECT id, topic, n, n_max FROM m"
    o["topic_authority"] = f"WITH {buyers}, {counts} SELECT id, topic, {f32('n / n_max * (ln(1.0 + n) / ln(101.0))')} AS authority FROM m"
    o["topic_similarity"] = Sql().out(f"""SELECT edge_id, {f32("CASE WHEN p_type = 'LARGE' THEN 0.5 ELSE length(p_type) / 16.0 END")} AS similarity
        FROM e JOIN part ON p_partkey = dst""")
    sql = Sql().add("te", "SELECT e.*, p_type AS topic FROM e JOIN part ON p_partkey = dst")
    sql.add("tc", "SELECT dst AS id, topic, count(*) AS n FROM te GROUP BY 1, 2")
    sql.add("au", """SELECT id, topic, n / (max(n) OVER (PARTITION BY id)) * (ln(1.0 + n) / ln(101.0)) AS authority FROM tc""")
    sql.add("rel", """SELECT e.edge_id, e.src, e.dst, 0.25 * coalesce(a.authority, 0) * 0.5 AS rel FROM e
        LEFT JOIN (SELECT * FROM au WHERE topic = 'PROMO') a ON a.id = e.dst""")
    sql.add("t1", "SELECT src AS id, dst AS target, sum(rel) AS score FROM rel GROUP BY 1, 2")
    sql.add("t2", """SELECT id, target, sum(score) AS score FROM (SELECT r.src AS id, t.target, t.score * 0.25 + r.rel AS score
        FROM rel r JOIN t1 t ON t.id = r.dst UNION ALL SELECT * FROM t1) GROUP BY 1, 2""")
    o["topical_scores"] = sql.out(f"SELECT id, target, {f32('score')} AS score FROM t2")
    # the third round for the seeds' own rows
    own = seeded(sql).add("t3", """SELECT id, target, sum(score) AS score FROM (SELECT r.src AS id, t.target, t.score * 0.25 + r.rel AS score
        FROM rel r JOIN t2 t ON t.id = r.dst WHERE r.src IN (SELECT seed FROM seeds)
        UNION ALL SELECT * FROM t1 WHERE id IN (SELECT seed FROM seeds)) GROUP BY 1, 2""")
    o["topical_scores_from"] = own.out(f"SELECT id, target, {f32('score')} AS score FROM t3")
    return o
