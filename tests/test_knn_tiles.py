"""J9 over vectors: a product bounds the distances of a tile, only pairs within the bound are summed."""

import numpy as np
import pytest

from ledgerlens.operators import knn


def in_order(q, t):
    d2 = np.zeros((len(q), len(t)))
    for c in range(q.shape[1]):
        d2 += np.square(q[:, c][:, None] - t[:, c][None, :])
    return d2


@pytest.mark.parametrize("shift", [0.0, 1e6, 1e160])
@pytest.mark.parametrize("exclude", [False, True])
def test_near_pairs_hold_the_nearest(shift, exclude):
    rng = np.random.default_rng(4)
    t = rng.normal(size=(500, 16)) + shift
    t[100:160] = t[7]  # copies
    q = np.concatenate([rng.normal(size=(30, 16)) + shift, t[5:10]])
    never = np.zeros((len(q), len(t)), bool)
    never[30:, 5:10] = np.eye(5, dtype=bool)
    i, j, d2 = knn._near_pairs(q, t, 6, never if exclude else None)
    want = in_order(q, t)
    assert (d2 == want[i, j]).all()
    if exclude:
        want[never] = np.inf
    for row in range(len(q)):
        at = np.flatnonzero(i == row)
        mine = [int(j[x]) for x in sorted(at, key=lambda x: (d2[x], j[x]))[:6]]
        assert mine == np.argsort(want[row], kind="stable")[:6].tolist()
    if shift == 0.0:
        assert len(i) < 6 * len(q) + 4 * 61


def test_tiles_return_what_all_pairs_return(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 5)).astype(np.float32)
    v[20:30] = v[3]
    df = spark.createDataFrame([("g", n, str(n % 3), x.tolist()) for n, x in enumerate(v)] + [("g", 99, "0", None)], "g string, id long, y string, v array<float>")
    want = in_order(v.astype(float), v.astype(float))
    np.fill_diagonal(want, np.inf)
    for rows, part in ((7, 4), (8192, 256)):
        monkeypatch.setattr(knn, "TILE_ROWS", rows)
        monkeypatch.setattr(knn, "SLICE", part)
        got = {}
        for r in knn.knn_vectors(df, df, keys=["g"], q_id="id", t_id="id", t_label="y", vec="v", k=4, exclude_self=True).collect():
            got.setdefault(r.q_id, {})[r.rank] = (r.t_id, r.d2)
        assert got == {n: {x + 1: (int(m), want[n, m]) for x, m in enumerate(np.argsort(want[n], kind="stable")[:4])} for n in range(60)}
