"""Steps of the elimination: few rows are ranked for a sample, few are placed again for the mutual information, few distances are made for a fold."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import selection as sel
from test_mi_nearest import direct


@pytest.fixture
def written(monkeypatch):
    """Rows of every table that the operators write, by name."""
    rows, plain = Counter(), sel.materialize

    def seen(df, name):
        out = plain(df, name)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(sel, "materialize", seen)
    return rows


def sampled(rows, num, per_class):
    """Sample of (id, class) rows of a group by sorting all of them."""
    if len(rows) <= num:
        return sorted(map(str, rows))
    rows = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}|42".encode()).hexdigest(), r[0]))
    took, head = Counter(), []
    for r in rows:
        took[r[1]] += 1
        if took[r[1]] <= per_class:
            head.append(r)
    ids = {i for i, _ in head}
    return sorted(map(str, head + [r for r in rows if r[0] not in ids][:num - len(head)]))


def test_sample_ranks_few_rows(spark, written):
    rng = random.Random(2)
    rows = {"big": [(i, "rare" if i < 7 else rng.choice("ab")) for i in range(20_000)], "small": [(i, rng.choice("ab")) for i in range(90)]}
    df = spark.createDataFrame([(g, i, y) for g, rs in rows.items() for i, y in rs], "g string, id long, y string")
    got = sel.sample_min_per_class(df, ["g"], "y", "id", num_samples=100, min_per_class=5).collect()
    for g, rs in rows.items():
        assert sorted(str((r.id, r.y)) for r in got if r.g == g) == sampled(rs, 100, 5)
    assert 0 < written["sample_first"] < 1_000


def test_sample_of_repeated_ids_is_filled(spark, written):
    first = min(range(600), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
    rows = [(first, "a")] * 300 + [(i, "ab"[i % 2]) for i in range(600) if i != first]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, id long, y string")
    got = sel.sample_min_per_class(df, ["g"], "y", "id", num_samples=100, min_per_class=5).collect()
    assert sorted(str((r.id, r.y)) for r in got) == sampled(rows, 100, 5) and len(got) == 100


def test_information_places_few_rows_again(spark, written, monkeypatch):
    monkeypatch.setattr(sel, "RANGE_ROWS", 200)
    rng = random.Random(5)
    rows = [("t", i, y := rng.choice("xxyz"), rng.gauss("xyz".index(y), 0.5) if i % 9 else float(i % 2)) for i in range(2_000)] + [("t", 3000 + i, "few", i / 3) for i in range(3)]
    df = spark.createDataFrame(rows, "tenant_id string, id long, y string, v double")
    got = sel.mi_nearest(df, ["tenant_id"], "y", ("v",), "id").collect()
    assert got[0].mi == pytest.approx(direct([(y, v) for _, _, y, v in rows]), abs=2e-9) and len(got) == 1
    assert 0 < written["mi_radius"] < 400 and 0 < written["mi_ends"] < 900 and written["mi_class"] < 1_500


def test_many_groups_and_classes(spark, monkeypatch):
    monkeypatch.setattr(sel, "RANGE_ROWS", 100)
    rng = random.Random(6)
    rows = [(f"g{i % 30:02}" if i % 3 else "big", i, str(rng.randrange(40)), rng.choice([None, round(rng.random(), 2), 1e9 * rng.random(), 0.0])) for i in range(900)]
    df = spark.createDataFrame(rows, "tenant_id string, id long, y string, v double")
    got = {r.tenant_id: r.mi for r in sel.mi_nearest(df, ["tenant_id"], "y", ("v",), "id").collect()}
    for t in {r[0] for r in rows}:
        assert got[t] == pytest.approx(direct([(y, v) for g, _, y, v in rows if g == t]), abs=2e-9)


@pytest.mark.parametrize("kinds", ["n", "c", "nn", "cc", "nc", "nncc", "kc"])
@pytest.mark.parametrize("n_r", [5, 400])
def test_search_equals_all_pairs(kinds, n_r, monkeypatch):
    monkeypatch.setattr(sel, "NEAR_ROWS", 20)
    rng = np.random.default_rng(3)
    terms = []
    for kind in kinds:
        if kind == "c":
            x, t = rng.integers(0, 4, 150), rng.integers(0, 3, n_r)
            terms.append((x, t, np.where(np.isin(x, t), 2.0, 1.0)))
        else:
            x, t = (np.full(150, 2.0), np.full(n_r, 2.0)) if kind == "k" else (rng.normal(size=150).round(1), rng.normal(size=n_r).round(1) * 3)
            terms.append((x, t, t.std() or 1.0))
    d2, made, plain = sel._distances(terms, np.arange(150), slice(None)), [], sel._distances
    monkeypatch.setattr(sel, "_distances", lambda *a: made.append(plain(*a)) or made[-1])
    at, near = sel._search(terms, 9)
    want = np.lexsort((np.broadcast_to(np.arange(n_r), d2.shape), d2))[:, :9]
    assert (at == want).all() and (near == np.take_along_axis(d2, want, 1)).all()
    if n_r == 400 and kinds in ("n", "c", "cc"):
        assert sum(m.size for m in made) < d2.size / 2


def test_digamma_of_arrays(spark):
    n = list(range(1, 50))
    want = [r.d for r in spark.createDataFrame([(i,) for i in n], "n long").orderBy("n").select(sel.digamma(F.col("n")).alias("d")).collect()]
    assert np.allclose(sel._digamma(np.array(n)), want, rtol=0, atol=1e-13)


def test_groups_without_candidates_give_no_rows(spark):
    rng = random.Random(1)
    keys = ["tenant_id", "table_name"]
    df = spark.createDataFrame([(t, "t", i, rng.choice("xy"), rng.random()) for t in "AB" for i in range(60)], "tenant_id string, table_name string, id long, y string, v double")
    cands = df.select(*keys).distinct().filter("tenant_id = 'A'").select(*keys, F.lit("v").alias("cand"), F.lit(True).alias("use_v"))
    conf = sel.cv_confusion(sel.stratified_folds(df, keys, "y", "id"), cands, keys, id_col="id", target="y", numeric=("v",)).collect()
    assert {r.tenant_id for r in conf} == {"A"} and sum(r.n for r in conf) == 60 * 8
