"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is ``size`` consecutive words of a document.  A word is removed when a
window covers it whose word sequence also starts earlier (smaller doc_id, or
the same document at an earlier word); windows are judged on the input.

Plan
1. Map: numpy hashes of all words and windows (two independent 64-bit hashes).
   Within a chunk of text only the first place of a window is sent on; the
   others are known to be repeats and travel in a bucket of their document's
   final group.  So a passage of a third of all documents sends its bucket an
   entry per chunk, not per document.  Entries travel packed, one row for each
   (bucket, chunk); the bucket of the others comes from the second hash.
2. Count: a bucket meets all places of its windows, sorts the hashes, and
   everything but the first place of a hash is a repeat.  The number of buckets
   grows with the text, so a bucket's size does not.
3. Apply: repeats go back to their documents, merge into maximal removal
   intervals and cut the words.

Two windows count as equal if 64 bits of the first hash and the bucket of the
second agree: 2^70 at 2M windows x 64 buckets, more as buckets are added.

Defined results: null text has no words; null doc_id sorts before all others;
rows with equal doc_id are ordered by their text's hash, and rows equal in both
are one document (none of them is earlier than the other), each returned;
extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C

#: Windows a bucket holds on average, and bytes of text a final group holds.
BUCKET_WINDOWS = 2_000_000
GROUP_BYTES = 12 << 20

_PACKED = "bucket int, did binary, dk binary, counts binary, starts binary, hashes binary"
_REPEATS = "g int, did binary, dk binary, counts binary, starts binary"


def _pack(doc: np.ndarray, start: np.ndarray, did: np.ndarray, dk: np.ndarray) -> dict:
    """Entries in (document, start) order as packed columns; did, dk by document."""
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    counts = np.diff(np.r_[at, len(doc)])
    return {"did": did[doc[at]].tobytes(), "dk": dk[doc[at]].tobytes(), "counts": C.pack_small(counts),
            "starts": C.pack_small(C.grouped_deltas(start, counts))}


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """did, dk, start of every entry."""
    counts = C.unpack_small(row["counts"])
    start = C.undo_deltas(C.unpack_small(row["starts"]), counts)
    return np.repeat(np.frombuffer(row["did"], np.int64), counts), np.repeat(np.frombuffer(row["dk"], np.int64), counts), start


def _group(did: np.ndarray, dk: np.ndarray, groups: int) -> np.ndarray:
    """Final group of documents, spread by id and text."""
    return (C.mix(did.astype(np.uint64) ^ C.mix(dk.astype(np.uint64))) % np.uint64(groups)).astype(np.int32)


def _places(size: int, buckets: int, groups: int):
    one, two = C.SpanHash(11), C.SpanHash(12)
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("did", "dk", "counts", "starts", "hashes"))])

    def rows(t: pa.Table) -> Iterator[dict]:
        did, dk = (t.column(c).to_numpy() for c in ("k", "dk"))
        order = np.lexsort((dk, did))
        did, dk = did[order], dk[order]
        new = np.r_[True, (did[1:] != did[:-1]) | (dk[1:] != dk[:-1])]
        did, dk = did[new], dk[new]
        raw, off = C.text_buffer(t.column("text").take(pa.array(order[new])))
        starts, ends, doc = C.words(raw, off)
        h1 = C.rolling(one(raw, starts, ends), size, 0x9E3779B97F4A7C15)
        h2 = C.rolling(two(raw, starts, ends), size, 0xC2B2AE3D27D4EB4F)
        if not len(h1):
            return
        inside = doc[:len(h1)] == doc[size - 1:]
        h1, h2, at = h1[inside], h2[inside], np.flatnonzero(inside)
        doc_at = doc[at]
        start = at - np.searchsorted(doc, doc_at)  # word number in its document
        by = np.argsort(h1, kind="stable")
        same = np.zeros(len(by), bool)
        same[by[1:]] = (h1[by[1:]] == h1[by[:-1]]) & (h2[by[1:]] == h2[by[:-1]])
        again, first = doc_at[same], start[same]
        g = _group(did, dk, groups)[again]
        by = np.argsort(g, kind="stable")
        cut = np.flatnonzero(np.diff(g[by], prepend=-1, append=groups))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            x = by[a:b]
            yield {"bucket": buckets + int(g[x[0]]), "hashes": b"", **_pack(again[x], first[x], did, dk)}
        h1, doc_at, start, bucket = h1[~same], doc_at[~same], start[~same], (h2[~same] % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            x = by[cut[b]:cut[b + 1]]
            yield {"bucket": int(b), "hashes": h1[x].tobytes(), **_pack(doc_at[x], start[x], did, dk)}

    def run(batches):
        for batch in batches:
            for t in C.chunks(batch):
                if out := list(rows(t)):
                    yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _repeats(groups: int):
    schema = pa.schema([("g", pa.int32()), *((c, pa.binary()) for c in ("did", "dk", "counts", "starts"))])

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        parts = [_unpack(r) for r in rows]
        did, dk, start = (np.concatenate([p[i] for p in parts]) for i in range(3))
        if rows[0]["hashes"]:  # else repeats that their chunk has found
            h = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
            by = np.argsort(h, kind="stable")
            eq = h[by[1:]] == h[by[:-1]]
            by = by[np.r_[False, eq] | np.r_[eq, False]]
            by = by[np.lexsort((start[by], dk[by], did[by], h[by]))]
            head = np.flatnonzero(np.r_[True, h[by[1:]] != h[by[:-1]]]) if len(by) else by
            first = np.repeat(by[head], np.diff(np.r_[head, len(by)]))
            by = by[(did[by] != did[first]) | (dk[by] != dk[first]) | (start[by] != start[first])]
            did, dk, start = did[by], dk[by], start[by]
        if not len(did):
            return schema.empty_table()
        g = _group(did, dk, groups)
        by = np.lexsort((start, dk, did, g))
        did, dk, start, g = did[by], dk[by], start[by], g[by]
        new = np.r_[True, (did[1:] != did[:-1]) | (dk[1:] != dk[:-1]) | (g[1:] != g[:-1])]
        doc = np.cumsum(new) - 1
        out, cut = [], np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for a, b in zip(cut, np.r_[cut[1:], len(g)], strict=True):
            out.append({"g": int(g[a]), **_pack(doc[a:b], start[a:b], did[new], dk[new])})
        return pa.Table.from_pylist(out, schema)

    return run


def _groups(groups: int):
    """Adds the final group of each document, as `_repeats` computes it, and packs the text for the shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("dk", pa.int64()), ("g", pa.int32()), ("size", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for t in C.chunks(batch):
                did, dk = t.column("k").to_numpy(), t.column("dk").to_numpy()
                g = _group(did, dk, groups)
                texts = C.texts(t.column("text"))
                yield pa.RecordBatch.from_pydict({"doc_id": t.column("doc_id").combine_chunks(), "k": did, "dk": dk, "g": g, "size": [len(x) for x in texts],
                                                  "packed": [codec.compress(x, asbytes=True) for x in texts]}, schema)

    return run


def _cut(size: int, keep_text: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
              ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    schema = pa.schema(fields + [("kept_text", pa.string())] * keep_text)

    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        parts = [_unpack(r) for r in repeats.select(["did", "dk", "counts", "starts"]).to_pylist()]
        found: dict[tuple[int, int], np.ndarray] = {}
        if parts:
            did, dk, start = (np.concatenate([p[i] for p in parts]) for i in range(3))
            by = np.lexsort((start, dk, did))
            did, dk, start = did[by], dk[by], start[by]
            at = np.flatnonzero(np.r_[True, (did[1:] != did[:-1]) | (dk[1:] != dk[:-1])])
            found = {(int(did[a]), int(dk[a])): start[a:b] for a, b in zip(at, np.r_[at[1:], len(did)], strict=True)}
        out, codec = {name: [] for name in schema.names}, pa.Codec("zstd", 1)
        for i, k, dk, size_of, packed in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "k", "dk", "size", "packed")), strict=True):
            have, s = codec.decompress(packed, size_of, asbytes=True).split(), found.get((k, dk))
            kept, removed, cuts = have, 0, []
            if s is not None:
                new = np.flatnonzero(np.r_[True, s[1:] > s[:-1] + size])  # touching windows merge
                a, b = s[new], np.r_[s[new[1:] - 1], s[-1]] + size
                stay = np.ones(len(have), bool)
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    stay[x:y] = False
                    cuts.append({"start": x, "end": y})
                kept = list(compress(have, stay.tolist()))
                removed = len(have) - len(kept)
            joined = b" ".join(kept)
            out["doc_id"].append(i)
            out["n_words"].append(len(have))
            out["n_removed"].append(removed)
            out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
            out["intervals"].append(cuts)
            if keep_text:
                out["kept_text"].append(joined.decode())
        return pa.Table.from_pydict(out, schema)

    return run


def substring_dedup(docs: DataFrame, size: int = 50, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, intervals (word ranges removed), kept_text.

    ``docs`` has doc_id and text.  ``keep_text=False`` leaves the last column out.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", C.id_key().alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("dk"))
    total = C.text_bytes(docs)
    buckets = max(1, -(-total // 6 // BUCKET_WINDOWS))
    groups = C.parts_for(spark, total, GROUP_BYTES)
    places = d.select("k", "dk", "text").mapInArrow(_places(size, buckets, groups), _PACKED)
    # partitions by the data's size, whatever the session's default
    repeats = places.repartition(max(buckets, spark.sparkContext.defaultParallelism), "bucket").groupBy("bucket").applyInArrow(_repeats(groups), _REPEATS)
    whole = d.mapInArrow(_groups(groups), "doc_id long, k long, dk long, g int, size long, packed binary")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<struct<start:long,end:long>>" + ", kept_text string" * keep_text
    whole, repeats = (x.repartition(groups, "g") for x in (whole, repeats))
    return whole.groupBy("g").cogroup(repeats.groupBy("g")).applyInArrow(_cut(size, keep_text), out)
