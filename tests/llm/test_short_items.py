"""Benchmark items of 1 to 19 characters; documents that share an id but not a text."""

import random

import brute

from ledgerlens.llm import decontaminate, minhash_dedup


def test_short_items_are_found_whole(spark):
    rng = random.Random(4)
    letters = "ab cdé-"
    items = [(n, "".join(rng.choice(letters) for _ in range(1 + n % 19))) for n in range(90)] + [(200, "É"), (201, "é"), (202, "!"), (203, " x  y "), (204, "19 characters or so"), (None, "a")]
    rows = [(i, "".join(rng.choice(letters + ", ") for _ in range(rng.randrange(40)))) for i in range(200)] + [(500, None), (501, ""), (502, "X-Y"), (503, "x"), (504, "y x"), (505, "...19 Characters, or SO."), (506, "é"), (506, "a" * 50_000 + " é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    words = lambda t: f" {brute.normal(t).decode()} "
    want = sorted((i, [n for n, x in items if n is not None and brute.normal(x) and words(x) in words(t)]) for i, t in rows)
    assert sorted((r.doc_id, r.items) for r in got) == want
    assert sum(map(bool, (n for _, n in want))) > 50
    text = dict(rows)
    for r in got:
        for x in r.regions:
            if r.doc_id != 506:
                assert words(text[r.doc_id][x.start:x.end]) == words(dict(items)[x.item_id]) and x.edits == 0
    assert {r.doc_id for r in got if 204 in r.items} == {505} and {r.doc_id for r in got if 203 in r.items} >= {502}


def test_texts_of_one_id_are_apart(spark):
    one = "one two three four five six seven eight nine ten"
    two = "red orange yellow green blue indigo violet black white grey"
    rows = [(3, one), (5, one), (5, two), (7, two), (7, two), (None, "alone"), (9, None), (9, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, k string")
    left = sorted((str(r.doc_id), r.text or "") for r in minhash_dedup.representatives(df).collect())
    assert left == sorted([("3", one), ("5", two), ("None", "alone"), ("9", ""), ("9", "")])
    again = minhash_dedup.representatives(df.filter("doc_id = 7"))  # equal rows are one document
    assert again.columns == ["doc_id", "text", "k"] and again.count() == 2
    assert minhash_dedup.representatives(df.limit(0)).count() == 0
