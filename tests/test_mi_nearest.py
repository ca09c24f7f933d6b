"""Nearest-neighbour mutual information against a direct computation; fold confusion counts; elimination rounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import selection as sel

KEYS = ["tenant_id", "table_name"]


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def direct(rows, k=3):
    """Estimate for (label, value) rows; null values take the median."""
    known = sorted(v for _, v in rows if v is not None)
    med = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if known else 0.0
    rows = [(y, med if v is None else v) for y, v in rows]
    size = {y: sum(z == y for z, _ in rows) for y, _ in rows}
    rows = [(y, v) for y, v in rows if size[y] > 1]
    total = 0.0
    for i, (y, v) in enumerate(rows):
        kk = min(k, size[y] - 1)
        r = sorted(abs(v - w) for j, (z, w) in enumerate(rows) if z == y and j != i)[kk - 1]
        m = sum((v - r < w < v + r) if r else w == v for _, w in rows)
        total += digamma(kk) - digamma(size[y]) - digamma(m)
    return max(0.0, digamma(len(rows)) + total / len(rows)) if rows else None


def test_digamma(spark):
    got = {r.n: r.d for r in spark.range(1, 60).select(F.col("id").alias("n"), sel.digamma(F.col("id")).alias("d")).collect()}
    assert all(abs(got[n] - digamma(n)) < 1e-11 for n in got)


def test_equals_direct(spark, monkeypatch):
    monkeypatch.setattr(sel, "MI_BLOCK", 5)  # classes over many blocks
    rng = random.Random(4)
    rows = []
    for t in "ABC":
        for i in range(70):
            y = rng.choice("xxyz")
            v = {"A": rng.gauss("xyz".index(y), 0.5), "B": float(rng.randrange(6)), "C": rng.random()}[t]
            rows.append((t, "t", len(rows), y, None if rng.random() < 0.1 else v, 1.0 if t == "C" else rng.random()))
    rows += [("A", "t", 900, "single", 0.1, 0.2), ("D", "t", 901, "x", 1.0, 1.0), ("E", "t", 902, "x", None, None), ("E", "t", 903, "x", None, float("nan"))]
    df = spark.createDataFrame(rows, "tenant_id string, table_name string, id long, y string, v double, w double")
    got = {(r.tenant_id, r.feature): r.mi for r in sel.mi_nearest(df, KEYS, "y", ("v", "w"), "id").collect()}
    for t in "ABCDE":
        for c, at in (("v", 4), ("w", 5)):
            want = direct([(r[3], None if r[at] is None or math.isnan(r[at]) else r[at]) for r in rows if r[0] == t])
            assert got.get((t, c)) == (None if want is None else pytest.approx(want, abs=2e-9)), (t, c)
    assert got["A", "v"] > 0.3 > got["A", "w"]
    assert sel.mi_nearest(df.limit(0), KEYS, "y", ("v",), "id").count() == 0


def test_confusion_and_rounds(spark):
    rng = random.Random(1)
    rows = [(t, "t", i, y := rng.choice("xyz"), "xyz".index(y) + rng.random() / 3, rng.random(), rng.choice("pq"), rng.choice("rst")) for t in "AB" for i in range(90)]
    df = spark.createDataFrame(rows, "tenant_id string, table_name string, id long, y string, v double, w double, c string, d string")
    cv, state, rounds = sel.backward_elimination(df, KEYS, id_col="id", target="y", numeric=("v", "w"), categorical=("c", "d"), must_have=("v",), with_rounds=True)
    said = sorted(rounds.collect(), key=lambda r: (r.tenant_id, r["round"]))
    final = {r.tenant_id: r.features for r in state.collect()}
    for t in "AB":
        mine = [r for r in said if r.tenant_id == t]
        left = ["c", "d", "v", "w"]
        for r in mine:
            left = [f for f in left if f != r.dropped]
            assert r.features == left and r.dropped != "v"
        assert final[t] == left and "v" in left
    sample = sel.stratified_folds(df, KEYS, "y", "id")
    cands = df.select(*KEYS).distinct().select(*KEYS, F.lit("v").alias("cand"), *[F.lit(f == "v").alias(f"use_{f}") for f in "vwcd"])
    how = {"id_col": "id", "target": "y", "numeric": ("v", "w"), "categorical": ("c", "d")}
    conf = sel.cv_confusion(sample, cands, KEYS, **how).collect()
    scores = {(r.tenant_id, r.k, r.weights, r.fold): (r.n_rows, r.n_correct) for r in sel.cv_fold_scores(sample, cands, KEYS, **how).collect()}
    assert sum(r.n for r in conf) == 180 * 8 and all(r.n > 0 for r in conf)
    for key, (n, right) in scores.items():
        mine = [r for r in conf if (r.tenant_id, r.k, r.weights, r.fold) == key]
        assert (n, right) == (sum(r.n for r in mine), sum(r.n for r in mine if r.y_true == r.y_pred)) and right > 0.9 * n
