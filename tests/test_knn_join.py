"""The search in tiles of a group: several tiles and slices, own k, ties, ids of several rows, and no index beside it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import ModelSpec
from ledgerlens.operators import knn, scoring


def _brute(refs, qs, k, n_num, same=False):
    out = {}
    for q_id, xs, ss, cs, known in qs:
        found = []
        for t_id, label, ys, ds in refs:
            if same and t_id == q_id:
                continue
            d2 = 0.0
            for x, y, s in list(zip(xs, ys, ss, strict=True))[:n_num]:
                d2 += ((x - y) / s) * ((x - y) / s)
            for c, d, kn in zip(cs, ds, known, strict=True):
                d2 += 0.0 if c == d else 2.0 if kn else 1.0
            found.append((d2, t_id, label))
        out.setdefault(q_id, []).extend(sorted(found)[:k])
    return {q: sorted(x)[:k] for q, x in out.items()}


@pytest.mark.parametrize("n_num", [0, 1, 2, 3])
def test_search_is_the_whole_comparison(n_num):
    rnd = random.Random(n_num)
    cats = [["a", "b", None], ["u", "v", "w", "x", None], ["m"]]
    refs = sorted((i // 2 if i < 20 else i, rnd.choice("PQ"), [float(rnd.choice([0, 1, 1, 2, rnd.gauss(0, 3)])) for _ in range(3)], [rnd.choice(c) for c in cats]) for i in range(300))
    qs = []
    for i in range(80):
        cs = [rnd.choice([*cats[0], "new"]), rnd.choice(cats[1]), "m"]
        qs.append((i, [float(rnd.choice([0, 1, 3, rnd.gauss(0, 3)])) for _ in range(3)], [1.5, 0.7, 2.0], cs, [cs[0] != "new", True, True]))
    codes = [{v: j for j, v in enumerate([None, *sorted({r[3][f] for r in refs} | {q[3][f] for q in qs}, key=str)])} for f in range(3)]
    import numpy as np

    col = lambda rows, at, f: np.array([r[at][f] for r in rows])
    cat = lambda rows, at: [np.array([codes[f][r[at][f]] for r in rows]) for f in range(3)]
    ids = np.array([r[0] for r in refs])
    for same in (False, True):
        tile = knn._Tile(len(refs), [col(refs, 2, f) for f in range(n_num)], cat(refs, 3), [len(c) for c in codes], ids if same else None)
        i, j, d2 = tile.nearest([col(qs, 1, f) for f in range(n_num)], [col(qs, 2, f) for f in range(n_num)], cat(qs, 3), [col(qs, 4, f) for f in range(3)],
                                np.full(len(qs), 4), np.array([q[0] for q in qs]) if same else None, 4)
        want = _brute(refs, qs, 4, n_num, same)
        got = {}
        for a, b, d in zip(i.tolist(), j.tolist(), d2.tolist(), strict=True):
            got.setdefault(qs[a][0], []).append((d, refs[b][0]))
        assert got == {q: [x[:2] for x in rows] for q, rows in want.items()}


def test_tiles_are_merged(spark, monkeypatch):
    rnd = random.Random(1)
    refs = [(g, i, rnd.choice("PQ"), rnd.choice([0.0, 1.0, rnd.gauss(0, 2)]), rnd.choice(["a", "b", None])) for g in ("g", "h") for i in range(90)]
    qs = [(g, i, rnd.gauss(0, 2), rnd.choice(["a", "b", None]), 2 if g == "g" else 5) for g in ("g", "h", "none") for i in range(25)]
    rdf = spark.createDataFrame(refs, "g string, id long, y string, x double, c string")
    qdf = spark.createDataFrame(qs, "g string, id long, x double, c string, k int")
    for name, rows in (("REF_ROWS", 20), ("QUERY_ROWS", 10), ("QUERY_SLICE", 4), ("PAIRS", 8)):
        monkeypatch.setattr(knn, name, rows)
    got = {}
    for r in sorted(knn.knn_join(qdf, rdf, keys=["g"], q_id="id", t_id="id", t_label="y", num=["x"], cat=["c"], k=5, k_col="k").collect(), key=lambda r: (r.g, r.q_id, r["rank"])):
        got.setdefault((r.g, r.q_id), []).append((r.d2, r.t_id, r.t_label))
    want = {}
    for g, k in (("g", 2), ("h", 5)):
        of = [(i, y, [x], [c]) for gg, i, y, x, c in refs if gg == g]
        want |= {(g, q): rows for q, rows in _brute(of, [(i, [x], [1.0], [c], [True]) for gg, i, x, c, _ in qs if gg == g], k, 1).items()}
    assert got == want


def test_a_model_that_is_not_saved_makes_no_index(spark):
    """Before, a scoring wrote an index of the references for each step of the search."""
    lines = spark.range(60).selectExpr("'A' tenant_id", "'t' table_name", "id", "if(id % 2 = 0, 'x', 'y') y", "cast(id % 3 as string) c", "double(id % 7) v", "double(id % 5) w")
    spec = ModelSpec(id_col="id", target="y", categorical=("c",), numeric=("v", "w"), k=3)
    model = scoring.fit(lines.filter(F.col("id") >= 20), spec)
    files = scoring.neighbors(model, lines.filter(F.col("id") < 20)).inputFiles()
    assert model.index is None and files and not any("knn_index" in f or "knn_ranges" in f or "knn_probes" in f for f in files)
    want = scoring.neighbors(model, lines.filter(F.col("id") < 20)).collect()
    model.neighbor_index()
    assert sorted(map(tuple, scoring.neighbors(model, lines.filter(F.col("id") < 20)).collect())) == sorted(map(tuple, want))
