"""Vector links against all pairs by numpy; recall of hard pairs; balls that are linked in part."""

import numpy as np
import pytest

from meterlark.llm import product_quantization as pq
from meterlark.llm.product_quantization import Index, balls, chord, near_vectors


def brute(ids, x, threshold=0.9):
    """{row: (n_links, component)} of all pairs."""
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    component = np.arange(len(x))
    for _ in range(len(x)):
        least = np.minimum(component, np.where(near, component[None, :], len(x)).min(axis=1))
        if (least == component).all():
            break
        component = least
    first = {c: min(i for i, k in zip(ids, component, strict=True) if k == c) for c in set(component.tolist())}
    return near, [first[c] for c in component.tolist()]


def beside(rng, x, cosine):
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(-1, keepdims=True) / (x * x).sum(-1, keepdims=True) * x
    return cosine * x / np.linalg.norm(x, axis=-1, keepdims=True) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=-1, keepdims=True)


def table(spark, x, kind="float"):
    rows = [(i, [float(np.float32(v)) if kind == "float" else float(v) for v in row], i % 3) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


@pytest.fixture(scope="module")
def mixture():
    """Loners, tight groups, a wide group whose members are linked in part, chains, exact and scaled copies."""
    rng = np.random.default_rng(11)
    loners = rng.standard_normal((1500, 24))
    tight = beside(rng, np.repeat(rng.standard_normal((3, 24)), [400, 60, 5], axis=0), 0.99)
    wide = beside(rng, np.repeat(rng.standard_normal((1, 24)), 150, axis=0), 0.945)  # pairs around 0.89
    pairs = beside(rng, loners[:200], 0.93)
    copies = np.repeat(loners[300:303], 20, axis=0) * rng.uniform(0.1, 9, 60)[:, None]
    chain = [rng.standard_normal(24)]
    for _ in range(12):
        chain.append(beside(rng, chain[-1], 0.92))
    x = np.concatenate((loners, tight, wide, pairs, copies, np.array(chain)))
    return x[rng.permutation(len(x))].astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("many", [4096, 20])
def test_links_of_a_mixture(spark, mixture, monkeypatch, many):
    monkeypatch.setattr(pq, "MANY", many)  # the second time lists fold again
    if many < 100:
        monkeypatch.setattr(pq, "BLOCK", 32)
        monkeypatch.setattr(pq, "VISITORS", 64)
        monkeypatch.setattr(pq, "CHUNK", 16)
    near, component = brute(range(len(mixture)), mixture)
    found = {r["vec_id"]: r for r in near_vectors(table(spark, mixture), list_size=128, probes=10).collect()}
    assert len(found) == len(mixture)
    n = np.array([found[i]["n_links"] for i in range(len(mixture))])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.98 * near.sum() and near.sum() > 160_000
    same = np.mean([found[i]["component_id"] == component[i] for i in range(len(mixture))])
    assert same > 0.98 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_every_link_when_all_lists_are_visited(spark, mixture):
    near, component = brute(range(len(mixture)), mixture)
    found = {r["vec_id"]: r for r in near_vectors(table(spark, mixture, "double"), list_size=512, probes=64).collect()}
    assert [found[i]["n_links"] for i in range(len(mixture))] == near.sum(axis=1).tolist()
    assert [found[i]["component_id"] for i in range(len(mixture))] == component


def test_balls_hold_only_linked_points():
    rng = np.random.default_rng(2)
    x = beside(rng, np.repeat(rng.standard_normal((40, 16)), 60, axis=0), 0.98)
    radius = 0.999 * chord(0.9) / 2
    of, firsts, middles, radii = balls(x, np.zeros(len(x)), np.ones(len(x), np.int64), radius)
    assert len(firsts) < 200 and (radii <= radius).all()
    for b in range(len(firsts)):
        rows = np.flatnonzero(of == b)
        assert firsts[b] in rows and (np.linalg.norm(x[rows] - middles[b], axis=1) <= radii[b]).all()
        assert (x[rows] @ x[rows].T >= 0.9).all()


def test_table_distances_and_two_levels(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 30))
    x /= np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(pq, "FINE", 16)
    index = Index(x, 120, 8)
    assert len(index.first) == 16 and len(index.second) == 8
    lists = index.own(x)
    code, err = index.codes(x, lists)
    at = int(np.bincount(lists).argmax())
    rows = np.flatnonzero(lists == at)
    told = index.distances(x[:50].astype(np.float32), at, code[rows])
    exact = np.linalg.norm(x[:50, None] - x[None, rows], axis=2)
    assert (np.abs(told - exact) <= err[rows] + 1e-3).all()  # the bound that the search relies on
    visits = index.visits(x[:20])
    every = np.linalg.norm(x[:20, None] - index.centre(np.arange(128))[None], axis=2)
    assert (every.argmin(axis=1) == visits[:, 0]).mean() > 0.9 and all(len(set(v)) == 8 for v in visits.tolist())


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    a = [1.0, 2.0, 3.0]
    rows = [(1, a), (2, [2.0, 4.0, 6.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, nan, 3.0]), (6, [1.0, None, 3.0]), (7, [1.0, 2.0]), (8, []), (9, a), (9, a), (None, [-1.0, -2.0, -3.0]), (10, [-1.0, -2.0, -3.1]), (11, [inf, 1.0, 1.0]), (12, [1e200, -1e200, 1e200]), (13, [3.0, -3.0, 3.0])]
    frame = spark.createDataFrame([(i, v, "x", 0, 1) for i, v in rows], "vec_id long, embedding array<double>, ball string, n int, uid int")
    found = near_vectors(frame).collect()
    assert len(found) == len(rows)
    by = {r["vec_id"]: r for r in found}
    assert (by[1]["n_links"], by[2]["n_links"], by[9]["n_links"]) == (3, 3, 3) and by[9]["component_id"] == 1 and not by[9]["kept"]
    for i in (3, 4, 5, 6, 7, 8, 11):
        assert by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"]
    assert by[10]["n_links"] == 1 and by[10]["component_id"] is None and not by[10]["kept"] and by[None]["kept"]
    assert by[13]["component_id"] == 12 and by[12]["n_links"] == 1
    assert near_vectors(frame.limit(0)).collect() == []
    assert near_vectors(frame.where("vec_id = 3")).count() == 1
