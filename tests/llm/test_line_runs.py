"""Line dedup: later copies of maximal equal runs go whole."""

import random

import brute

from ledgerlens.llm import common, line_dedup


def sentence(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n))


def test_extended_runs_go_whole(spark):
    rng = random.Random(8)
    lines = [sentence(rng, rng.choice([1, 3, 6, 12])) for _ in range(40)]
    rows = [(0, "\n".join([sentence(rng, 60), sentence(rng, 40)]))]
    rows += [(i, rows[0][1]) for i in range(1, 4)]
    for i in range(4, 60):
        own = [sentence(rng, 4) for _ in range(rng.randrange(5))]
        at, cut = rng.randrange(30), rng.randrange(len(own) + 1)
        rows.append((i, "\n".join([*own[:cut], *lines[at:at + rng.randrange(9)], *own[cut:]])))
    rows += [(70, rows[9][1]), (81, "\n".join([sentence(rng, 9)] * 30)), (90, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for min_words in (10, 50):
        got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(df, min_words=min_words).collect()}
        assert got == brute.line_dedup(rows, min_words)
    assert got[1] == got[3] == (2, 2, "")
    left = {r.doc_id for r in line_dedup.deduplicated(df).collect()}
    assert left >= {0, 90, 91} and not left & {1, 2, 3}


def test_hot_runs_and_very_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(common, "HOT_SHARE", 0.02)  # the shared run is hot, others are not
    shared = "\n".join(sentence(rng, 7) for _ in range(12))
    rows = [(i, "\n".join([sentence(rng, 30), shared, sentence(rng, 60)])) for i in range(40)]
    rows += [(50, rows[3][1]), (51, "\n".join([*(sentence(rng, 9) for _ in range(400)), shared, *(sentence(rng, 9) for _ in range(400))])), (52, sentence(rng, 120_000)), (53, "x " * 200_000)]
    rows += [(54, rows[-1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(df).collect()}
    few = [r for r in rows if r[0] != 51]
    want = brute.line_dedup(few, 50)
    assert {i: got[i] for i in want} == want and got[54] == (1, 1, "")
    assert got[51][:2] == (812, 12) and shared not in got[51][2]
