"""Mutual information and folds count all rows of a group, above the sample's size too."""

import math
import random
from collections import Counter
from statistics import median

import pytest

from ledgerlens.operators import selection as sel
from ledgerlens.plans import q_select

KEYS = ["tenant_id", "table_name"]


def brute_mi(pairs):
    n, xy, xs, ys = len(pairs), Counter(pairs), Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    return sum(c / n * math.log(c * n / (xs[x] * ys[y])) for (x, y), c in xy.items())


def bins(values):
    some = [v for v in values if v is not None]
    filled = [median(some) if v is None else v for v in values] if some else [0] * len(values)
    below, seen = {}, 0
    for v in sorted(filled):
        below.setdefault(v, seen)
        seen += 1
    return [math.floor(below[v] * 10.0 / len(values)) for v in filled]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(12_500):
        y = rng.choice("abc")
        out.append(("big", "t", i, y, None if rng.random() < 0.1 else round(rng.gauss(ord(y) - 97, 1), 1), float(i < 11_000), rng.choice("pq") + y * (i > 11_000)))
    out += [("small", "t", 50_000 + i, rng.choice("ab"), rng.choice([None, 1.0, 2.0, 5.0]), 0.0, "p") for i in range(30)]
    out += [("none", "t", 60_000 + i, rng.choice("ab"), None, float(i), "p") for i in range(20)]
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, table_name string, o_orderkey long, o_orderpriority string, o_totalprice double, c_acctbal double, o_orderstatus string") \
                .selectExpr("*", "o_orderstatus as c_mktsegment")


def test_queries_take_all_rows(spark, rows, frame, monkeypatch):
    monkeypatch.setattr(q_select, "selection_input", lambda spark, d: frame)
    folds = q_select.stratified_folds(spark, "").collect()
    assert len(folds) == len({r.o_orderkey for r in folds}) == len(rows)
    got = {(r.tenant_id, r.feature): r.mi for q in (q_select.mi_discrete, q_select.mi_numeric) for r in q(spark, "").collect()}
    for g in ("big", "small", "none"):
        mine = [r for r in rows if r[0] == g]
        y = [r[3] for r in mine]
        for feature, x in (("o_orderstatus", [r[6] for r in mine]), ("o_totalprice", bins([r[4] for r in mine])), ("c_acctbal", bins([r[5] for r in mine]))):
            assert got[g, feature] == pytest.approx(brute_mi(list(zip(x, y, strict=True))), abs=2e-9), (g, feature)


def test_folds_are_ranks_by_md5(frame, rows):
    import hashlib
    by_class = {}
    for r in rows:
        by_class.setdefault((r[0], r[3]), []).append((hashlib.md5(f"{r[2]}|42".encode()).hexdigest(), r[2]))
    want = {i: n % 5 for v in by_class.values() for n, (_, i) in enumerate(sorted(v))}
    assert {r.o_orderkey: r.fold for r in sel.stratified_folds(frame, KEYS, "o_orderpriority", "o_orderkey").collect()} == want
