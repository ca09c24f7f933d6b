"""Repeats found inside a chunk are spread over groups by document."""

import pyarrow as pa

from ledgerlens.llm import substring_dedup


def test_repeats_of_many_tasks_are_spread():
    text = "a b c d e f " * 6
    out = []
    for n in range(200):  # a task of one chunk each
        run = substring_dedup._places(4, 50, 40)
        out += [r for b in run([pa.RecordBatch.from_pydict({"k": [n, 1000 + n], "dk": [n, 7 * n], "text": [text, text]})]) for r in b.to_pylist()]
    found = [r for r in out if not r["hashes"]]
    held = {}
    for r in found:
        did, dk, start = substring_dedup._unpack(r)
        held[r["bucket"]] = held.get(r["bucket"], 0) + len(start)
        assert {r["bucket"] - 50} == set(substring_dedup._group(did, dk, 40).tolist())
    assert all(0 <= r["bucket"] < 50 for r in out if r["hashes"])
    assert len(held) == 40 and max(held.values()) < 4 * sum(held.values()) / 40
