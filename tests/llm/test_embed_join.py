import math

import numpy as np
import pytest

from blockwalk.llm import embed_join as ej

SCHEMA = "vec_id long, embedding array<float>, digest int, component string"


def brute(rows, cosine):
    vec = []
    for key, e, *_ in rows:
        v = np.array(e, np.float64) if e and all(x is not None for x in e) else np.zeros(1)
        vec.append(v / np.sqrt((v**2).sum()) if key is not None and np.isfinite(v).all() and (v != 0).any() else None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and vec[i] is not None and vec[j] is not None and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] >= cosine] for i in range(n)]
    low = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                if low[j] < low[i]:
                    low[i], changed = low[j], True
    return sorted([(r[0], len(links[i]), low[i], r[0] is not None and low[i] == r[0]) for i, r in enumerate(rows)], key=str)


def table(dim, seed=3):
    rng = np.random.default_rng(seed)
    rows = []

    def put(v):
        rows.append((len(rows) * 3, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 1, "c"))

    for size, noise in ((30, 0.2), (12, 0.05), (8, 0.33), (1, 0)) * 3:
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            put(centre * rng.uniform(0.5, 3) + noise * rng.standard_normal(dim) / math.sqrt(dim))
    same = rng.standard_normal(dim)
    for _ in range(40):
        put(same)
    put(same * 2)
    put(same * 4096)
    for _ in range(150):
        put(rng.standard_normal(dim))
    for v in (None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), list(same[: dim - 1]), list(same[: dim - 1])):
        put(v)
    rows.append((None, [float(np.float32(x)) for x in same], 1, "c"))
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


@pytest.mark.parametrize(("dim", "shard"), [(64, ej.SHARD), (64, 40), (64, 9), (20, 25), (3, 30), (1, 50)])
def test_against_brute_force(spark, dim, shard):
    rows = table(dim)
    got = ej.near_vectors(spark.createDataFrame(rows, SCHEMA), shard=shard).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 0.95)


def test_empty_table_repeated_rows_other_threshold(spark):
    rows = table(16)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert ej.near_vectors(docs.limit(0)).collect() == []
    assert sorted(map(tuple, ej.near_vectors(docs, cosine=0.8, shard=30).collect()), key=str) == brute(rows, 0.8)
    one = next(r for r in rows if r[0] is not None and r[1] and len(r[1]) == 16 and all(x is not None and x == x and abs(x) < 1e9 for x in r[1]) and any(r[1]))
    assert [tuple(r) for r in ej.near_vectors(spark.createDataFrame([one] * 3, SCHEMA)).collect()] == [(one[0], 2, one[0], True)] * 3


def pairs_of(seed, n, dim, noise=0.2):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, dim))
    unit = np.concatenate((a, a + noise * rng.standard_normal((n, dim))))
    return unit / np.linalg.norm(unit, axis=1, keepdims=True) @ ej.rotation(dim)


@pytest.mark.parametrize("depth", [0, 1, 3, 6])
def test_pigeonhole_and_exactly_one_meeting(depth):
    dim, n = 32, 40
    unit = pairs_of(8, n, dim)
    share = ej.budgets(dim, 0.95)
    meets = {}
    for k, block in enumerate(ej.blocks_of(dim)):
        row, cell, visits = ej.cells_of(unit[:, block], ej.tree_of(unit[:, block], depth), share[k])
        homes = dict(zip(row[~visits].tolist(), cell[~visits].tolist(), strict=True))
        guests = set(zip(row[visits].tolist(), cell[visits].tolist(), strict=True))
        assert len(homes) == 2 * n
        for i in range(n):
            x, y = homes[i], homes[n + i]
            meets[k, i] = (x == y) + ((i, y) in guests) + ((n + i, x) in guests)
    for i in range(n):
        away = np.array([((unit[i, s] - unit[n + i, s]) ** 2).sum() for s in ej.blocks_of(dim)])
        if unit[i] @ unit[n + i] >= 0.95:
            assert (away <= share).any()
        assert all(meets[k, i] == 1 for k in np.flatnonzero(away <= share))


@pytest.mark.parametrize(("within", "leaf", "same"), [(True, 192, False), (True, 8, False), (False, 8, False), (True, 8, True)])
def test_sketches_lose_no_pair(monkeypatch, within, leaf, same):
    """Every pair within the budgets is found; only rows near one are."""
    monkeypatch.setattr(ej, "_LEAF", leaf)
    dim, n = 64, 300
    unit = pairs_of(5, n, dim, 0.3)
    unit[2:12] = unit[2]
    if same:
        unit[:200, :8] = unit[0, :8]
    share, block = ej.budgets(dim, 0.95), ej.blocks_of(dim)[0]
    shown = ej.sketch(unit)[:, ej.sketched(block, dim)]
    own, others = (np.arange(2 * n), np.arange(0)) if within else (np.arange(n), np.arange(n, 2 * n))
    a, b = ej.partners(shown[own], shown[others], 8, share[0], share.sum(), within)
    away = ((unit[:, None, :] - unit[None, :, :]) ** 2).sum(2)
    near = ((unit[:, None, block] - unit[None, :, block]) ** 2).sum(2)
    linked = (away <= share.sum()) & (near <= share[0]) & ~np.eye(2 * n, dtype=bool)
    if not within:
        linked[:n, :n] = linked[n:, n:] = False
    assert linked.any() and (~linked.any(1)).any()
    got = a if within else np.concatenate((a, b))
    assert got[linked.any(1)].all()
    seen = ej.sketched(block, dim)
    loose = ((unit[:, None, seen] - unit[None, :, seen]) ** 2).sum(2) <= 0.2
    np.fill_diagonal(loose, False)
    assert not got[~loose.any(1)].any()


def test_a_dense_cell_is_split(spark):
    """Many distinct vectors that all link, in one cell of every block."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(k, [float(np.float32(x)) for x in centre + 0.01 * rng.standard_normal(16)], 1, "c") for k in range(120)]
    for shard, verified in ((20, 10), (1000, 7)):
        got = ej.near_vectors(spark.createDataFrame(rows, SCHEMA), shard=shard, verified=verified).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, 0.95)


def test_double_precision_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 50, rng.standard_normal(8).tolist(), 1, "c") for k in range(100)]
    rows += [(200 + k, [x * (1 + 1e-12) for x in rows[k][1]], 1, "c") for k in range(40)]
    got = ej.near_vectors(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()
    assert len(got) == 140 and all(r["n_links"] > 0 for r in got if r["vec_id"] >= 200)
