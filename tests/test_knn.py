"""Exact kNN join vs brute force, incl. band/fallback paths, unseen and null categories, ties."""

import random

import pytest

from ledgerlens.operators import knn


def make_rows(seed, n_groups=3, n_ref=60, n_q=20):
    rnd = random.Random(seed)
    cats = ["a", "b", "c", None]
    refs, qs = [], []
    i = 0
    for g in range(n_groups):
        for _ in range(n_ref if g else 4):  # group 0 has fewer refs than k
            x = rnd.choice([0.0, 0.5, 1.0, rnd.gauss(0, 1), rnd.gauss(3, 0.1)])
            refs.append((f"g{g}", i, rnd.choice("PQR"), x, rnd.choice(cats), rnd.choice(["u", "v"])))
            i += 1
        for _ in range(n_q):
            x = rnd.gauss(0, 1.5)
            qs.append((f"g{g}", i, x, rnd.choice(cats + ["unseen"]), rnd.choice(["u", "v", None])))
            i += 1
    return refs, qs


def brute(refs, qs, k, exclude_self=False):
    known = {}
    for g, _, _, _, c1, c2 in refs:
        known.setdefault(g, (set(), set()))
        known[g][0].add(c1)
        known[g][1].add(c2)
    out = {}
    for g, qid, x, c1, c2 in qs:
        cand = []
        for rg, tid, lab, rx, r1, r2 in refs:
            if rg != g or (exclude_self and tid == qid):
                continue
            d2 = (x - rx) ** 2
            d2 += 0.0 if c1 == r1 else (2.0 if c1 in known[g][0] else 1.0)
            d2 += 0.0 if c2 == r2 else (2.0 if c2 in known[g][1] else 1.0)
            cand.append((d2, tid))
        cand.sort()
        out[qid] = [t for _, t in cand[:k]]
    return out


@pytest.mark.parametrize("seed", [7, 8])
def test_knn_join_matches_brute_force(spark, seed):
    refs, qs = make_rows(seed)
    known = {}
    for g, _, _, _, c1, c2 in refs:
        known.setdefault(g, (set(), set()))
        known[g][0].add(c1)
        known[g][1].add(c2)
    qrows = [(g, qid, x, c1, c2, c1 in known[g][0], c2 in known[g][1]) for g, qid, x, c1, c2 in qs]
    qdf = spark.createDataFrame(qrows, "g string, id long, x double, c1 string, c2 string, k1 boolean, k2 boolean")
    rdf = spark.createDataFrame(refs, "g string, id long, y string, x double, c1 string, c2 string")
    nb = knn.knn_join(qdf, rdf, keys=["g"], q_id="id", t_id="id", t_label="y", num=["x"], cat=["c1", "c2"],
                      known=["k1", "k2"], k=5).collect()
    got = {}
    for r in sorted(nb, key=lambda r: (r["q_id"], r["rank"])):
        got.setdefault(r["q_id"], []).append(r["t_id"])
    exp = brute(refs, qs, 5)
    assert got == exp


def test_self_join_excludes_self_and_handles_duplicates(spark):
    rows = [("g", i, "L", 1.0, "a", "u") for i in range(12)] + [("g", 100 + i, "M", float(i), "b", "v") for i in range(5)]
    rdf = spark.createDataFrame(rows, "g string, id long, y string, x double, c1 string, c2 string")
    nb = knn.knn_join(rdf, rdf, keys=["g"], q_id="id", t_id="id", t_label="y", num=["x"], cat=["c1", "c2"],
                      k=3, exclude_self=True).collect()
    qs = [(g, i, x, c1, c2) for g, i, _, x, c1, c2 in rows]
    exp = brute(rows, qs, 3, exclude_self=True)
    got = {}
    for r in sorted(nb, key=lambda r: (r["q_id"], r["rank"])):
        got.setdefault(r["q_id"], []).append(r["t_id"])
    assert got == exp


def test_vote_rules(spark):
    rows = [("g", 1, 1, "B", 0.0), ("g", 1, 2, "A", 1.0), ("g", 1, 3, "A", 1.0),     # zero distance wins
            ("g", 2, 1, "B", 1.0), ("g", 2, 2, "A", 1.0),                          # tie -> smaller label
            ("g", 3, 1, "A", 4.0), ("g", 3, 2, "B", 1.0), ("g", 3, 3, "A", 4.0)]   # 1/2+1/2 = 1 = 1/1 -> A
    df = spark.createDataFrame(rows, "g string, q_id long, rank int, t_label string, d2 double")
    dist = {r["q_id"]: r["prediction"] for r in knn.vote(df, ["g"], "distance").collect()}
    uni = {r["q_id"]: r["prediction"] for r in knn.vote(df, ["g"], "uniform").collect()}
    assert dist == {1: "B", 2: "A", 3: "A"}
    assert uni == {1: "A", 2: "A", 3: "A"}


def test_vector_knn(spark):
    rnd = random.Random(3)
    refs = [("g", i, str(i % 3), [rnd.random() for _ in range(8)]) for i in range(80)]
    qs = [("g", 1000 + i, [rnd.random() for _ in range(8)]) for i in range(15)]
    rdf = spark.createDataFrame(refs, "g string, id long, y string, v array<double>")
    qdf = spark.createDataFrame(qs, "g string, id long, v array<double>")
    knn.TILE_ROWS, rows = 8, knn.TILE_ROWS
    nb = knn.knn_vectors(qdf, rdf, keys=["g"], q_id="id", t_id="id", t_label="y", vec="v", k=4).collect()
    knn.TILE_ROWS = rows
    got = {}
    for r in sorted(nb, key=lambda r: (r["q_id"], r["rank"])):
        got.setdefault(r["q_id"], []).append(r["t_id"])
    for _, qid, qv in qs:
        d = sorted((round(sum((a - b) ** 2 for a, b in zip(qv, rv)), 9), tid) for _, tid, _, rv in refs)
        assert got[qid] == [t for _, t in d[:4]]


def test_heavy_tails_several_numerics_and_scales(spark):
    """Lognormal amounts keep their order: no fixed decimals, equal only if equal."""
    rnd = random.Random(5)
    value = lambda: round(rnd.lognormvariate(0, 2.5), 2)
    refs = [("g", i, "PQR"[i % 3], value(), value(), rnd.choice("abc")) for i in range(400)]
    qs = [("g", 1000 + i, value(), value(), rnd.choice("abcd")) for i in range(60)]
    s1, s2 = 37.5, 81.0
    rdf = spark.createDataFrame(refs, "g string, id long, y string, x1 double, x2 double, c string")
    qdf = spark.createDataFrame([(*q, s1, s2, q[4] != "d") for q in qs], "g string, id long, x1 double, x2 double, c string, s1 double, s2 double, known boolean")
    for used in (1, 2):
        num, scale = ["x1", "x2"][:used], ["s1", "s2"][:used]
        nb = knn.knn_join(qdf, rdf, keys=["g"], q_id="id", t_id="id", t_label="y", num=num, scale=scale, cat=["c"], known=["known"], k=7).collect()
        got = {}
        for r in sorted(nb, key=lambda r: (r["q_id"], r["rank"])):
            got.setdefault(r["q_id"], []).append(r["t_id"])
        for _, qid, a, b, c in qs:
            d = sorted((((a - x) / s1) ** 2 + (((b - y) / s2) ** 2 if used == 2 else 0) + (0 if c == k else 1 if c == "d" else 2), tid) for _, tid, _, x, y, k in refs)
            assert got[qid] == [t for _, t in d[:7]]


def test_no_numeric_and_no_feature(spark):
    rdf = spark.createDataFrame([("g", i, "L", "ab"[i % 2]) for i in range(30)], "g string, id long, y string, c string")
    qdf = spark.createDataFrame([("g", 100, "b"), ("h", 101, "b")], "g string, id long, c string")
    ids = lambda **how: [r["t_id"] for r in sorted(knn.knn_join(qdf, rdf, keys=["g"], q_id="id", t_id="id", t_label="y", k=3, **how).collect(), key=lambda r: r["rank"])]
    assert ids(cat=["c"]) == [1, 3, 5] and ids() == [0, 1, 2]
