"""Blocks of buckets are bounded by their bytes of text."""

import random
from collections import Counter

import brute

from ledgerlens.llm import minhash_dedup

LIMIT = 4000


def watched(meet):
    def make(size, threshold):
        run = meet(size, threshold)

        def check(batches):
            held, seen = list(batches), Counter()
            for b in held:
                for r in b.to_pylist():
                    seen[r["key"], r["r"], r["d"]] += len(r["text"].encode())
            assert max(seen.values(), default=0) < 6 * LIMIT, seen.most_common(3)
            yield from run(iter(held))

        return check

    return make


def test_long_documents_meet_in_blocks_by_bytes(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for n in range(60):  # one template, changed so that most are no near copies
        if n % 3 == 0:
            base = [f"w{k}" for k in range(200)]
            for k in rng.sample(range(200), 12):
                base[k] = f"x{rng.randrange(10 ** 6)}"
        w = list(base)
        w[rng.randrange(200)] = f"y{n}"
        rows.append((n, " ".join(w)))
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", LIMIT, raising=False)
    monkeypatch.setattr(minhash_dedup, "_meet", watched(minhash_dedup._meet))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df, shingle=3, threshold=80).collect()}
    assert got == brute.classes(rows, 3, 80)
