import numpy as np
import pyarrow as pa
import pytest

from quaywork.llm import embedding_dedup
from quaywork.llm.embedding_dedup import near_vectors, smallest_reached


def brute(rows, least):
    ok = [i for i, (v, x) in enumerate(rows) if v is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    width = max(len(rows[i][1]) for i in ok)
    m = np.array([[*rows[i][1], *[0] * (width - len(rows[i][1]))] for i in ok], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    hit = m @ m.T >= least
    np.fill_diagonal(hit, False)
    ids = np.array([rows[i][0] for i in ok])
    reach = np.array([ids[smallest_reached(hit) == r].min() for r in smallest_reached(hit)])
    out = {v: (0, v, v is not None) for v, _ in rows}
    out |= {int(v): (int(h.sum()), int(r), bool(v == r)) for v, h, r in zip(ids, hit, reach, strict=True)}
    return out


def vectors(seed, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n // 4):
        base = rng.normal(size=16)
        for noise in (0, 0.02, 0.3, 0.05):
            rows.append([*map(float, base + noise * rng.normal(size=16))])
    centre = rng.normal(size=16)
    rows += [[*map(float, centre + 0.02 * rng.normal(size=16))] for _ in range(150)]
    rows += [rows[3]] * 30
    ids = rng.permutation(len(rows)) + 10
    return [(int(i), x) for i, x in zip(ids, rows, strict=True)]


@pytest.mark.parametrize(("cell", "block"), [(1024, 2048), (100, 2048), (100, 37)])
def test_links_equal_those_of_all_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors(cell + block)
    rows += [(1, None), (2, [0.0] * 16), (3, [float("nan")] * 16), (4, [1.0, None]), (5, [float("inf")] * 16), (6, []), (None, rows[0][1]), (7, [1.0]), (8, [1.0, 0.01])]
    frame = spark.createDataFrame([(*r, 3, "z") for r in rows], "vec_id long, embedding array<float>, copies int, rep string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect()}
    want = brute(rows, 0.95)
    assert len(got) == len(want)
    if cell == 1024:
        assert got == want
    else:  # a few links may lie between cells that are not shared
        found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
        assert all(got[v][0] <= want[v][0] for v in want) and found >= 0.98 * there


def near_pairs(clustered):
    """12,000 vectors, half of them partners of others at a cosine from 0.95 to 0.97."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 48))
    base = rng.normal(size=(6000, 48)) + (3 * centres[rng.integers(0, 40, 6000)] if clustered else 0)
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.951, 0.97, 6000)[:, None]
    return np.concatenate([base, c * base + np.sqrt(1 - c * c) * side])


@pytest.mark.parametrize(("clustered", "most"), [(False, 4096), (True, 4096), (False, 12), (True, 12)])
def test_recall_with_many_more_cells_than_each_vector_is_in(spark, monkeypatch, clustered, most):
    monkeypatch.setattr(embedding_dedup, "CELL", 64)  # 188 cells; or 12, split into about 16 each
    monkeypatch.setattr(embedding_dedup, "MOST_CELLS", most)
    x = near_pairs(clustered)
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))})).repartition(8)
    got = {r.vec_id: r for r in near_vectors(frame).collect()}
    hit = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1) >= 0.95
    np.fill_diagonal(hit, False)
    want = hit.sum(axis=1)
    found = sum(r.n_links for r in got.values())
    print(f"clustered {clustered}, most {most}: {found} of {want.sum()} ends of links")
    assert len(got) == len(x) and all(r.n_links <= want[v] for v, r in got.items())
    assert found >= 0.98 * want.sum() > 11_000


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    got = near_vectors(spark.createDataFrame([(3, None), (None, [1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, 0, 3, True), (None, 0, None, False)], key=str)
