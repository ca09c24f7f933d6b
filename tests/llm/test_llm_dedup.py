"""Substring, line and near-duplicate removal against brute force, with odd rows."""

import random

import brute
import numpy as np
import pytest

from ledgerlens.llm import line_dedup, minhash_dedup, substring_dedup
from ledgerlens.llm.components import components

ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "é 日本 x" * 3)]
CLASH = "doc_id long, text string, k string, dk string, g int, bucket int, _row string, runs string, id long, component long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 1, 2, "c", "d", 3, 4) for i, t in rows], CLASH)


def sentence(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(4)
    shared = [sentence(rng, 30) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(30)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(4), rng.choice(shared))
        rows.append((i, rng.choice("\n ").join(parts)))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (5000, " ".join(shared) * 3), (80, sentence(rng, 20000) + "\n" + rows[9][1])]
    return rows + ODD


def test_substring_dedup(spark, passages, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 500)  # many buckets
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(spark, passages), size=8).collect()}
    want = brute.substring_dedup(passages, 8)
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    for i, r in got.items():
        assert brute.sha(r.kept_text.encode()) == r.kept_sha256
        assert sum(x.end - x.start for x in r.intervals) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.intervals, r.intervals[1:], strict=False)), i


def test_substring_dedup_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "x a b c d"), (2, "q q q q")]
    got = sorted((r.doc_id is not None, r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, rows), size=4).collect())
    assert got == [(False, None, 4, 0), (True, 1, 4, 4), (True, 1, 4, 4), (True, 2, 4, 0), (True, 2, 5, 4)]
    assert substring_dedup.substring_dedup(frame(spark, []), size=4).count() == 0


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(6)
    lines = [sentence(rng, rng.choice([1, 3, 6, 12])) for _ in range(40)]
    rows = []
    for i in range(60):
        own = [sentence(rng, 4) for _ in range(rng.randrange(5))]
        at = rng.randrange(30)
        run = lines[at:at + rng.randrange(8)]
        cut = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join([*own[:cut], *(x + rng.choice(["", " ", "\r"]) for x in run), "", *own[cut:]])))
    return rows + [(70, rows[5][1]), (81, "\n".join([sentence(rng, 9)] * 40))] + ODD


def test_line_dedup(spark, lined):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(frame(spark, lined), min_words=10).collect()}
    assert got == brute.line_dedup(lined, 10)
    assert sum(n for _, n, _ in got.values()) > 50


def test_line_dedup_keeps_columns_and_drops_emptied(spark):
    rows = [(1, "a b c\nd e f", 11), (2, "a b c\nd e f", 11), (3, "x\na b c\nd e f", 13), (4, None, None), (4, None, None), (5, "", 0)]
    df = spark.createDataFrame([(i, t, n, "z") for i, t, n in rows], "doc_id long, text string, n_chars long, _text string")
    out = line_dedup.deduplicated(df, min_words=6)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_chars, r._text) for r in out.collect() if r.text is not None) == [(1, "a b c\nd e f", 11, "z"), (3, "x", 1, "z"), (5, "", 0, "z")]
    assert out.filter("text is null").count() == 2
    assert line_dedup.deduplicated(df.limit(0)).count() == 0


def test_windows_hold_the_words_asked_for():
    words, doc = np.array([3, 9, 1, 1, 20, 4, 4]), np.array([0, 0, 0, 0, 0, 1, 1])
    first, stop, chosen = line_dedup.windows(words, doc, np.array([5, 5, 9, 9, 9, 1, 0], np.uint64), 8)
    assert list(zip(first, stop, chosen, strict=True)) == [(0, 2, 1), (1, 2, 1), (2, 5, 4), (3, 5, 4), (4, 5, 4), (5, 7, 6)]


def near_copies(rng, n_words, n, edits):
    base = sentence(rng, n_words).split()
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = "e" + str(rng.randrange(1000))
        out.append(" ".join(w))
    return out


def test_minhash_dedup(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)  # buckets of many blocks
    rng = random.Random(9)
    texts = [t for n, k, e in ((120, 30, 9), (60, 12, 4), (200, 12, 20), (40, 5, 3)) for t in near_copies(rng, n, k, e)]
    chain = sentence(rng, 100).split()
    for step in range(8):  # each near the next, the ends far apart
        texts.append(" ".join(chain[:step * 2] + [f"n{step}"] + chain[step * 2 + 1:]))
        chain[step * 2] = f"m{step}"
    texts += [texts[0].upper(), texts[0] + " ", texts[40]] + [sentence(rng, 50) for _ in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + ODD + [(910, "One  TWO"), (911, "x")]
    got = minhash_dedup.near_duplicates(frame(spark, rows), shingle=3, threshold=80).collect()
    want = brute.classes(rows, 3, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)
    left = minhash_dedup.representatives(frame(spark, rows), shingle=3, threshold=80)
    assert left.columns == [f.split()[0] for f in CLASH.split(", ")]
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_minhash_dedup_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d"), (1, "p q r s"), (1, "a b c d"), (2, "p q r s"), (3, "p q r s"), (3, "p q r s")]
    got = sorted(str((r.doc_id, r.component_id, r.kept)) for r in minhash_dedup.near_duplicates(frame(spark, rows), 3, 80).collect())
    assert got == sorted(map(str, [(None, None, True), (1, None, False), (1, None, False), (2, None, False), (3, None, False), (3, None, False)]))
    assert minhash_dedup.near_duplicates(frame(spark, []), 3, 80).count() == 0


def test_pruning_misses_almost_nothing():
    least = minhash_dedup.least_matches(85, 100)
    assert list(least) == sorted(least) and least[100] < 85 and least[100] > 50


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(i, 500) for i in range(501, 560)]
    up = {x: x for p in links for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up if any(x in p and p[0] != p[1] for p in links)}
