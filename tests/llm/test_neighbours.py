import numpy as np
import pytest

from lakelens.llm import neighbours as N
from lakelens.session import stage_table

SCHEMA = "chunk_pos long, vector array<float>, pos string, vec int, id int"


def frame(spark, rows):
    return spark.createDataFrame([(p, v, "x", 1, 2) for p, v in rows], SCHEMA)


def brute(rows, k=5, threshold=0.9):
    ok = [(p, np.array(v, np.float32).astype(float)) for p, v in rows if v is not None and len(v) == 64 and None not in v]
    ok = [(p, v / np.linalg.norm(v)) for p, v in ok if np.isfinite(v).all() and v.any()]
    out = set()
    for p, v in ok:
        near = sorted((-round(float(v @ w), 6), q) for q, w in ok if q != p and v @ w >= threshold - 1e-12)[:k]
        out |= {(min(p, q), max(p, q)) for _, q in near}
    return out


def cloud(seed, clusters=40, size=9):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((clusters, 64))
    m = (centre[:, None] + 0.28 * rng.standard_normal((clusters, size, 64))).reshape(-1, 64) * rng.choice([0.5, 1, 2], (clusters * size, 1))
    return [(n, row.astype(np.float32).tolist()) for n, row in enumerate(m)]


def pairs(df, **more):
    return {(r.chunk_pos_a, r.chunk_pos_b) for r in N.similar_pairs(df, stage_table, **more).collect()}


@pytest.mark.parametrize("cell", [3000, 40])
def test_recall_against_brute_force(spark, cell):
    rows = cloud(1)
    want, got = brute(rows), pairs(frame(spark, rows), cell=cell)
    assert len(want) > 300 and len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)
    if cell == 3000:
        assert got == want


def test_crowded_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "_BASE", 50)
    rows = cloud(2)
    assert pairs(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("share", [None, 700])
def test_recall_within_a_dense_group_of_a_third_of_all(spark, monkeypatch, share):
    if share:
        monkeypatch.setattr(N, "_ASKED", share)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    hot = centre / np.linalg.norm(centre) + 0.036 * rng.standard_normal((2000, 64))
    m = np.concatenate([hot, rng.standard_normal((4000, 64))]).astype(np.float32)
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    cosine = unit[:2000] @ unit[:2000].T
    np.fill_diagonal(cosine, -1)
    want = {(min(a, int(b)), max(a, int(b))) for a, row in enumerate(np.argsort(-cosine, axis=1)[:, :5]) for b in row if cosine[a, b] >= 0.9}
    got = pairs(frame(spark, [(n, row.tolist()) for n, row in enumerate(m)]), cell=60)
    assert len(want) > 5000 and len(got & want) >= 0.99 * len(want) and len(got & want) >= 0.99 * len(got)


def test_equal_vectors_and_ties(spark):
    v, w = np.eye(64)[0].tolist(), (np.eye(64)[0] + 0.1 * np.eye(64)[1]).tolist()
    rows = [(n, v) for n in range(20)] + [(n, w) for n in range(20, 24)]
    assert pairs(frame(spark, rows)) == brute(rows)


def test_unusable_rows(spark):
    good, near = np.ones(64), np.ones(64)
    near[0] = 1.1
    bad = np.ones(64)
    bad[3] = np.nan
    huge = np.full(64, 3e38)
    inf = np.ones(64)
    inf[2] = np.inf
    some = [1.0] * 63 + [None]
    rows = [(1, None), (2, []), (3, [1.0] * 63), (4, [0.0] * 64), (5, bad.tolist()), (6, inf.tolist()), (7, some), (8, good.tolist()), (9, near.tolist()), (10, huge.tolist()), (None, good.tolist())]
    assert pairs(frame(spark, rows)) == {(8, 9), (8, 10), (9, 10)}
    assert pairs(frame(spark, rows[:7])) == set()
    assert pairs(frame(spark, [])) == set()


def test_the_table_scan_loses_nothing():
    raw = np.array([v for _, v in cloud(3)], np.float32)
    unit = N._unit(raw)
    centre = N.fit_cells(unit, 1)
    books = N.fit_books(unit, unit - centre[0])
    cell = N.Cell(np.arange(len(raw)), raw, centre[0], books, 0.9)
    a, b, c = cell.search(np.arange(len(raw)), raw, 1000, 0.9)
    exact = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(exact >= 0.9)) if i != j}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_the_loss_weighs_parallel_error_more():
    rng = np.random.default_rng(0)
    x = N._unit(rng.standard_normal((2000, 64)))
    books = N.fit_books(x, x)
    codes = N.encode(x, x, books)
    plain = np.stack([((x.reshape(-1, 16, 4)[:, m, None] - books[m]) ** 2).sum(axis=2).argmin(axis=1) for m in range(16)], axis=1)

    def parallel(c):
        error = x - np.concatenate([books[m][c[:, m]] for m in range(16)], axis=1)
        return np.abs((error * x).sum(axis=1)).mean()

    assert parallel(codes) < 0.75 * parallel(plain)
