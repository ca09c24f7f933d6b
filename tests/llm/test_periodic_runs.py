"""Periodic runs against a test of every period."""

import random

import brute
import numpy as np
import pytest

from ledgerlens.llm import periodic_runs as P
from ledgerlens.llm import queries

CLASH = "doc_id long, text string, runs string, start int, n_words string, length int"


def all_periods(w, least=6, times=4):
    """Runs by comparing words q apart, for every q; the smallest period of each stretch."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, times * q) and i > s:
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def digest(text):
    w = brute.words(text)
    runs = all_periods(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, brute.sha(listed.encode()), brute.sha(collapsed(w, runs)))


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "x a b a b a b a b y", "é 日本 " * 9, "a\x1cb " * 8, "lone\nlone\n" * 3000]
    for _ in range(250):
        w = [rng.choice("abcde") + str(rng.randrange(rng.choice([1, 2, 40]))) for _ in range(rng.randrange(150))]
        if rng.random() < 0.5 and w:
            p, at = rng.randrange(1, 20), rng.randrange(len(w))
            w[at:at] = (w[at:at + p] * 9)[:rng.randrange(9 * p)]
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out + [out[20], out[20] + " " + out[20]]


def test_equals_every_period(spark):
    rows = list(enumerate(texts())) + [(None, "b b b b b b"), (3, "b b b b b b")]
    df = spark.createDataFrame([(i, t, "r", 1, "n", 2) for i, t in rows], CLASH)
    got = P.periodic_runs(df).collect()
    key = lambda r: tuple(map(str, r))
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(((r.doc_id, *(r[c] for c in names)) for r in got), key=key) == sorted(((i, *digest(t)) for i, t in rows), key=key)
    for r in got:
        assert brute.sha(r.collapsed_text.encode()) == r.collapsed_sha256 and len(r.runs) == r.n_runs
    assert sum(r.n_runs for r in got) > 60
    assert P.periodic_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("least, times", [(6, 4), (4, 4), (3, 3), (12, 4), (9, 3)])
def test_small_alphabets(least, times):
    rng = random.Random(least)
    for _ in range(120):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randrange(90))]
            docs.append((w * 7)[:rng.randrange(200)] if rng.random() < 0.4 else w)
        off = np.cumsum([0, *map(len, docs)])
        got = P.find_runs(np.array(sum(docs, []), np.int64), off, least, times)
        assert got == [(s + off[k], n, q) for k, d in enumerate(docs) for s, n, q in all_periods(d, least, times)]


def test_pairs_stay_few_in_one_long_run():
    w = np.tile(np.arange(3), 60_000)
    assert P.find_runs(w, np.array([0, len(w)])) == [(0, 180_000, 3)]


def test_planted_repeats(spark):
    import zlib
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b c d")]
    got = {r.doc_id: r.text for r in queries.planted_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for i, t in rows:
        w = brute.words(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got[i].encode() == b" ".join(w[k if k < a else a + (k - a) % p] for k in range(n))
            changed += 1
        else:
            assert got[i] == t
    assert changed > 2


def test_times_below_three_are_refused(spark):
    with pytest.raises(ValueError):
        P.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), times=2)
