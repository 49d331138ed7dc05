"""Neighbours by shells around pivots against all pairs, and how many pairs they spare."""

import numpy as np
import pytest

from colloquy.operators import neighbours, vectors

SCHEMA = "tenant_id long, id long, speaker_id string, embedding array<double>"


def rows_of(found):
    return sorted((r.query, r.place, r.id, r.speaker_id, round(r.sim, 8)) for r in found.collect())


def plain(rows, asked, k, others=True):
    """All pairs of a tenant, one by one."""
    unit = {}
    for _, i, _, v in rows:
        a = np.array(v if v is not None else [], float)
        norm = np.linalg.norm(a)
        unit[i] = a / norm if norm >= 1e-8 else a * 0
    out = []
    for t, q, *_ in asked:
        if t is not None:
            near = sorted((-round(float(unit[q] @ unit[i]) if len(unit[q]) == len(unit[i]) else 0.0, 9), i, s) for u, i, s, _ in rows if u == t and not (others and i == q))
            out += [(q, place + 1, i, s, round(-sim, 8) + 0.0) for place, (sim, i, s) in enumerate(near[:k])]
    return sorted(out)


def odd(seed, n):
    """Clusters, copies, nulls, empty, zero and short vectors, in a large, a small and no tenant."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 8))
    rows = []
    for i in range(n):
        v = [float(x) for x in centers[i % 12] + rng.normal(size=8) * 0.1]
        v = {0: None, 1: [], 2: [0.0] * 8, 3: v[:5]}.get(i % 40, [float(x) for x in centers[3]] if i % 5 == 0 else v)
        rows.append((None if i % 60 == 7 else int(i % 9 == 0), i, f"s{i % 7}", v))
    return rows


@pytest.mark.parametrize("k, others, per_block", [(3, True, 10), (1, False, 25), (400, True, 30)])
def test_all_pairs(spark, k, others, per_block):
    rows = odd(k, 240)
    asked = [r for r in rows if r[1] % 3 == 0 or r[1] % 40 < 4]
    found = neighbours.nearest(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(rows, SCHEMA), k, others, "tenant_id", per_block)
    assert [x[:4] for x in rows_of(found)] == [x[:4] for x in plain(rows, asked, k, others)]


@pytest.mark.parametrize("few", [0, 1024])
@pytest.mark.parametrize("k, others", [(1, False), (3, True), (400, True)])
def test_all_pairs_in_parts(spark, monkeypatch, few, k, others):
    """Blocks of both sides meet in parts of the pool, or, with many tenants, by a join on them."""
    for name, value in (("FEW", few), ("PART", 300), ("PACKED", 100), ("POOL_BLOCK", 20), ("BLOCK", 20)):
        monkeypatch.setattr(vectors, name, value)
    rows = odd(k, 240)
    rows += [(t, 1000 + i, s, [x * (1 + 1e-12 * i) for x in v] if v else v) for t, i, s, v in rows[100:160]]  # alike to nine digits
    asked = [r for r in rows if r[1] % 3 == 0 or r[1] % 40 < 4]
    found = vectors.nearest(spark.createDataFrame(asked, SCHEMA).repartition(3), spark.createDataFrame(rows, SCHEMA), k, others, "tenant_id")
    assert [x[:4] for x in rows_of(found)] == [x[:4] for x in plain(rows, asked, k, others)]


@pytest.mark.parametrize("picked", [0, vectors.PICKED])
def test_single_precision_only_rules_out(monkeypatch, picked):
    """Pairs that single precision cannot tell apart are compared exactly, one by one or, if they are many, all of them."""
    monkeypatch.setattr(vectors, "PICKED", picked)
    rng = np.random.default_rng(3)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    q = unit(rng.normal(size=(300, 16)))
    for n in (40, 3000):
        p = unit(q[:n][rng.integers(0, min(n, 300), n)] + rng.normal(size=(n, 16)) * 1e-6)
        names = rng.permutation(n)
        sides = (q, np.full(300, 16, np.int32)), (p, np.full(n, 16, np.int32))
        sims = np.einsum("ij,kj->ik", q, p)
        for k in (1, 4):
            want = [names[np.lexsort((names, -np.round(s, 9)))[:k]].tolist() for s in sims]
            found = [np.concatenate(x) for x in zip(*vectors._met(*sides, np.arange(300), names, k, False, np.full(300, -np.inf)), strict=True)]
            assert names[found[1]].reshape(300, k).tolist() == want
            floor = np.sort(sims, axis=1)[:, -k]
            again = [np.concatenate(x) for x in zip(*vectors._met(*sides, np.arange(300), names, k, False, floor), strict=True)]
            assert all((a == b).all() for a, b in zip(found, again, strict=True))
            assert not list(vectors._met(*sides, np.arange(300), names, k, False, np.full(300, 1.1)))


def test_empty_sides(spark):
    rows, none = spark.createDataFrame(odd(1, 20), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(none, rows, 2).count() == neighbours.nearest(rows, none, 2).count() == 0


def test_empty_sides_in_parts(spark):
    rows, none = spark.createDataFrame(odd(1, 20), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert vectors.nearest(none, rows, 2).count() == vectors.nearest(rows, none, 2).count() == vectors.nearest(rows, none, 2, by="tenant_id").count() == 0


def test_clusters_spare_most_pairs(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 32))
    rows = [(i % 2, i, "s", [float(x) for x in centers[i % 40] + rng.normal(size=32) * 0.15]) for i in range(4000)]
    pool = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    asked = pool.where("id % 25 = 0")
    found = neighbours.nearest(asked, pool, 5, by="tenant_id", per_block=40)
    assert rows_of(found) == rows_of(vectors.nearest(asked, pool, 5, by="tenant_id"))
    cost = neighbours.comparisons(asked, pool, 5, by="tenant_id", per_block=40).collect()[0]
    print(cost)
    assert cost.pairs == 160 * 2000 and cost.compared < 0.3 * cost.pairs


def test_centroids_of_uneven_vectors(spark):
    rows = [("a", [3.0, 0.0]), ("a", [1.0, 0.0, 4.0]), ("a", None), ("a", []), ("b", [0.0, 0.0]), ("c", None), ("d", [None, 2.0]), (None, [5.0])]
    table = spark.createDataFrame(rows, "speaker_id string, embedding array<float>")
    found = {r.speaker_id: ([round(x, 6) for x in r.centroid], r.n) for r in vectors.centroids(table).collect()}
    norm = np.hypot(2, 4)
    assert found == {"a": ([round(2 / norm, 6), 0.0, round(4 / norm, 6)], 2), "b": ([0.0, 0.0], 1), "d": ([0.0, 1.0], 1), None: ([1.0], 1)}
    assert vectors.centroids(table.limit(0)).count() == 0
    assert "Python" not in vectors.centroids(table)._jdf.queryExecution().executedPlan().toString()
