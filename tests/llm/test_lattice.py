"""E8 lattice hashing: exact decoding, recall and precision against all pairs, edge rows."""

import numpy as np
import pytest

from tidewright.llm import lattice as L

SCHEMA = "vec_id long, embedding array<float>, label int, N_LINKS string"


def brute(rows, limit=0.9):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = x @ x.T >= limit
    np.fill_diagonal(links, False)
    label = L.spanning_roots(len(ids), *np.nonzero(links))
    return {i: (int(n), min(ids[k] for k in np.flatnonzero(label == c))) for i, n, c in zip(ids, links.sum(1), label, strict=True)}


def test_decoding_is_nearest():
    x = np.random.default_rng(2).normal(size=(300, 8)) * 2
    point = L.decode(x)
    assert (np.isclose(point % 1, 0).all(1) | np.isclose(point % 1, 0.5).all(1)).all() and (point.sum(1) % 2 == 0).all()
    own = ((x - point) ** 2).sum(1)
    assert (own <= 1 + 1e-9).all()
    for v in L.shortest_vectors():
        assert (own <= ((x - point - v) ** 2).sum(1) + 1e-9).all()
    assert len({tuple(v) for v in L.shortest_vectors()}) == 240 and np.allclose((L.shortest_vectors() ** 2).sum(1), 2)


@pytest.mark.parametrize("piece", [8, 1024])
def test_families(spark, monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    monkeypatch.setattr(L, "ROWS", piece * 3)
    rng = np.random.default_rng(4)
    rows = []
    for size in (1, 1, 2, 3, 40, 1, 5) + (1,) * 100:
        base = rng.normal(size=64)
        for _ in range(size):
            v = base + rng.normal(size=64) * 0.2
            rows.append((3 * len(rows) + 2, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist(), 0, ""))
    rows += [(1_000_000, rows[5][1], 1, ""), (1, rows[5][1], 1, "")]
    short = [(2_000_000 + i, [1.0 + i / 100, 1.0, 0.5 * (i % 2)], 0, "") for i in range(30)]
    out = {r.vec_id: (r.n_links, r.component_id) for r in L.near_duplicates(spark.createDataFrame(rows + short, SCHEMA)).collect()}
    assert out == brute(rows) | brute(short)


def pairs_at(cosine, n, rng):
    x, z = rng.normal(size=(2, n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


def meet(a, b):
    return (a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)


@pytest.mark.parametrize("most", [m for m, *_ in L.SETTINGS])
def test_recall_at_the_threshold(most):
    """At every setting, two vectors of cosine 0.9 meet in some table."""
    blocks, step, tables = L.setting(most or 10**9)
    x, y = pairs_at(0.9, 1500, np.random.default_rng(5))
    a, b = (L.cells(v, tables, blocks, L.PROBES, step) for v in (x, y))
    assert meet(a, b).any(1).mean() > 0.97


@pytest.mark.parametrize("n", [2000, 20_000, 80_000])
def test_comparisons_do_not_grow(n):
    """Unrelated vectors that a vector is compared with, from the chance that two of them meet."""
    blocks, step, tables = L.setting(n)
    x = np.random.default_rng(6).normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a = L.cells(x, tables, blocks, L.PROBES, step)
    rate = np.mean([meet(a, np.roll(a, k, 0)).any(1).mean() for k in range(1, 120)])
    assert rate * n < 45


def test_edges(spark):
    rows = [(1, None, 0, ""), (2, [], 0, ""), (3, [0.0, 0.0], 0, ""), (4, [1.0, None], 0, ""), (5, [float("nan"), 1.0], 0, ""),
            (6, [float("inf"), 1.0], 0, ""), (7, [1.0, 0.0], 0, ""), (8, [1.0, 0.1], 0, ""), (9, [1.0, 0.0, 0.0], 0, ""),
            (7, [1.0, 0.0], 0, ""), (10, [0.0, 1.0], None, None)]
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in L.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)]
    assert out == sorted([*alone, (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False)])
    assert L.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [2000, 6000])
def test_table(spark, n):
    """Families about the threshold among unrelated vectors: every row against all pairs, at two settings."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    family = rng.integers(0, n // 20, n // 2)
    x[: n // 2] = rng.normal(size=(n // 20, 64))[family] + x[: n // 2] * rng.uniform(0.1, 0.4, (n // 2, 1))
    rows = [(i, v.astype(np.float32).tolist(), 0, "") for i, v in enumerate(x)]
    out = {r.vec_id: (r.n_links, r.component_id) for r in L.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    expected = brute([(i, np.float32(v).astype(float)) for i, v in enumerate(x)])
    links = sum(k for k, _ in expected.values())
    assert links > 1000 and sum(k for k, _ in out.values()) >= 0.985 * links
    assert sum(out[i] == e for i, e in expected.items()) >= 0.95 * n
    assert all(out[i][0] <= k for i, (k, _) in expected.items())


def test_spanning_roots():
    assert list(L.spanning_roots(5, np.array([0, 3]), np.array([3, 1]))) == [0, 0, 2, 0, 4]


def test_candidates_both_ways(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8)) + 1.5
    x /= np.linalg.norm(x, axis=1)[:, None]
    group = np.repeat([0, 1, 2, 3], [1, 20, 4, 35])
    one = sorted(zip(*L._candidates(x, group, 0.9), strict=True))
    monkeypatch.setattr(L, "SMALL", 3)
    assert one == sorted(zip(*L._candidates(x, group, 0.9), strict=True)) and len(one) > 10
