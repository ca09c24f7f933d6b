"""Spelling variants against a comparison of all words."""

import collections
import random
import re
import zlib

import numpy as np

from ledgerlens.llm import queries
from ledgerlens.llm import spelling as S


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def groups(counts, ratio=5):
    """{word: (n, n_near, form, form_n, root)} of {word: n}."""
    out, form = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(near), form[w], counts.get(form[w]))
    for w in out:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] += (root,)
    return out


def vocabulary(rng, n):
    counts = {}
    for _ in range(n):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 14)))
        counts[w] = 5 ** rng.randrange(9) + rng.randrange(3)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w))
            counts.setdefault(rng.choice([w[:k] + w[k + 1:], w[:k] + "b" + w[k:], w[:k] + "z" + w[k + 1:]]), rng.randrange(1, 40))
    return {w: c for w, c in counts.items() if w} | {"x" * 3000: 7, "x" * 3001: 80, "x" * 2999 + "y": 3, "日本語日本語": 5, "日本語日本": 50}


def collected(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_equals_all_comparisons(spark, monkeypatch):
    counts = vocabulary(random.Random(3), 250)
    words = spark.createDataFrame([(w, n, "k", 1) for w, n in counts.items()], "word string, n long, key string, m int")
    want = groups(counts)
    assert sum(v[2] is not None for v in want.values()) > 50 and any(v[4] != v[2] != None for v in want.values())  # noqa: E711
    assert collected(S.variant_groups(words)) == want
    monkeypatch.setattr(S, "BLOCK", 4)  # many blocks of a key
    monkeypatch.setattr(S, "TILE", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups over several batches
    try:
        assert collected(S.variant_groups(words, ratio=2)) == groups(counts, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_chains_and_empty_tables(spark):
    counts = {"a" * k + "b" * (30 - k): 5 ** k for k in range(18)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = collected(S.variant_groups(words))
    assert got == groups(counts) and got["b" * 30][4] == "a" * 17 + "b" * 13
    assert S.variant_groups(words.limit(0)).count() == 0
    assert collected(S.variant_groups(words.limit(1)))


def test_common_counts_from_the_front():
    a, back = S.matrices(["abcd", "abd", ""])
    assert S.common(a, a).tolist() == [[4, 2, 0], [2, 3, 0], [0, 0, 0]]
    assert S.common(back, back).tolist() == [[4, 1, 0], [1, 3, 0], [0, 0, 0]]
    i, j = S.near_pairs(["abcdef", "abcdxf"], np.zeros(2, int), np.zeros(2, int), np.zeros(2, bool), np.full(2, 6), np.full(2, 2))
    assert (i.tolist(), j.tolist()) == ([0], [1])


def test_query_on_odd_documents(spark, tmp_path):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeÉß") for _ in range(rng.randrange(5, 9))) for _ in range(40)]
    docs = [(i, rng.choice(["1", " ", "_"]).join(w.title() if rng.random() < 0.3 else w for w in rng.choices(vocab, k=400))) for i in range(150)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (900, None), (901, ""), (902, "×÷ " * 9 + "Ünïcode ünïcode " * 9)]
    spark.createDataFrame([(i, t, "w") for i, t in docs], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    want = groups({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    assert collected(queries.QUERIES["op13_spelling_variants"](spark, str(tmp_path))) == want and any(v[2] for v in want.values())
