"""Exact amounts, and mass that runs through hubs."""

from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockwalk import from_edges
from blockwalk.functions import mass
from blockwalk.operators import blocks
from blockwalk.operators.ppr import hub_ppr

UNIT = Fraction(1, 2**93)
value = st.one_of(st.floats(0, 2**20), st.floats(0, 1e-15), st.integers(0, 2**24).map(float))


def parts(x):
    return x / UNIT if (x / UNIT).denominator == 1 else Fraction(int(x / UNIT))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(value, st.integers(1, 2**31 - 1)), min_size=1, max_size=30))
def test_shares_add_up_exactly(spark, rows):
    table = spark.createDataFrame(rows, "x double, d long")
    shares = mass.divided(mass.from_double(F.col("x")), F.col("d"))
    summed = table.select(*[s.alias(n) for n, s in zip(mass.names("m"), shares, strict=True)]).agg(*[F.sum(n).alias(n) for n in mass.names("m")])
    out = mass.carried([F.col(n) for n in mass.names("m")])
    *limbs, double = summed.select(*out, mass.to_double(out)).first()
    want = sum(int(parts(Fraction(x)) / d) for x, d in rows)
    assert all(0 <= v < 2**31 for v in limbs[1:])
    assert sum(Fraction(v, 2 ** (31 * k)) for k, v in enumerate(limbs)) == want * UNIT
    assert abs(Fraction(double) - want * UNIT) <= abs(want * UNIT) * Fraction(1, 2**51)


def test_scaling_by_a_fraction(spark):
    table = spark.createDataFrame([(x,) for x in (1.0, 100000.0, 3.0e-20, 0.0, 12345.678)], "x double")
    for factor in (0.85, 0.15, 1 / 3, 1.0):
        got = table.select("x", mass.to_double(mass.scaled(mass.from_double(F.col("x")), factor)).alias("y")).collect()
        assert all(abs(r["y"] - r["x"] * factor) <= 1e-15 * r["x"] + 1e-27 for r in got)


def hubs_in_a_row(width, hubs=3):
    """1 -> many -> 2 -> many -> 3 ...: every hub passes all it has to ``width`` vertices, of which
    one leads to the next hub; five vertices follow the last."""
    edges = []
    for h in range(1, hubs + 1):
        first = 1000 * 1000 * h
        edges += [(h, first + k) for k in range(width)]
        edges.append((first, h + 1 if h < hubs else 500))
    return edges + [(500 + k, 501 + k) for k in range(4)]


def plain(edges, seeds, rounds, keep=1.0, fade=None):
    out, deg = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        deg[a] = deg.get(a, 0) + 1
    score, inc = {s: v for s, v in seeds.items()}, {(s, s): v for s, v in seeds.items()}
    score = {(s, s): v for s, v in seeds.items()}
    for _ in range(rounds):
        came = {}
        for (v, s), x in inc.items():
            for to in out.get(v, ()):
                came[to, s] = came.get((to, s), 0.0) + x * keep / deg[v]
        for k, x in came.items():
            score[k] = score.get(k, 0.0) * (1.0 if fade is None else fade) + x
        inc = came
    return score


def test_mass_below_the_old_unit_runs_through_hubs(spark):
    edges = hubs_in_a_row(1100)
    graph, seeds = from_edges(spark, edges), spark.createDataFrame([(1, 1.0)], "seed long, value double")
    want = plain(edges, {1: 1.0}, 11)
    got = {(r["id"], r["seed"]): r["score"] for r in blocks.propagate(graph, seeds, 11, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) <= 1e-12 * v for k, v in want.items())
    assert {k: v for k, v in got.items() if k[0] in (500, 504)}.keys() == {(500, 1), (504, 1)}
    assert 0 < got[504, 1] < 1e-9
    assert blocks.unvisited_vertices(graph, blocks.propagate(graph, seeds, 11, 3)).count() == 0
    for rule, fade in (("reference", 0.15), ("sum", None)):
        want = plain(edges, {1: 1.0}, 11, 0.85, fade)
        got = {(r["id"], r["seed"]): r["score"] for r in hub_ppr(graph, seeds, 11, rule=rule).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) <= 1e-9 * v for k, v in want.items())


def test_reach_does_not_depend_on_the_amount(spark):
    """Beyond 2^-93 of a unit amounts are 0, and still travel."""
    edges = hubs_in_a_row(900, 11)
    graph, seeds = from_edges(spark, edges), spark.createDataFrame([(1, 1.0)], "seed long, value double")
    got = {r["id"]: r["score"] for r in blocks.propagate(graph, seeds, 26, 2).collect()}
    assert got[504] == 0.0 and got[9] > 0
    assert len(got) == graph.vertices.count()
