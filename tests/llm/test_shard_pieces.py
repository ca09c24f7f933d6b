"""Sharding with a text that is spread over many range partitions."""

import collections

import pytest

from ledgerlens.llm import sharding


@pytest.mark.parametrize("part_rows", [7, 50])
def test_a_hot_text_in_many_pieces(spark, monkeypatch, part_rows):
    monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
    rows = [(i, "hot passage" if i % 3 == 0 else None if i % 17 == 0 else f"text {i % 90}") for i in range(300)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _part int, shard int")
    got = {r.doc_id: r for r in sharding.shard(df, 5).collect()}
    assert len(got) == 300 and all(r.law == "bytes" and r.grown_shard is None for r in got.values())
    first, slots, shards = {}, collections.defaultdict(list), collections.defaultdict(set)
    for i, t in rows:
        first.setdefault(t or "", i)
        slots[got[i].shard].append((first[t or ""], i, got[i].slot))
        shards[t or ""].add(got[i].shard)
    assert all(len(x) == 1 for x in shards.values())
    for found in slots.values():  # by first document of the text, then by document
        assert [s for _, _, s in sorted(found)] == list(range(len(found)))
