"""Benchmark decontamination by the q-gram lemma, diagonal bands and banded alignment.

Benchmark items are cut into overlapping segments of ``SEGMENT`` characters.  A
text region with at most k edits to a segment of m characters shares at least
m + 1 - q (k + 1) of its q-grams, all on diagonals (text position minus segment
position) at most k apart.  So shared q-grams are counted per segment and band
of diagonals, bands overlap by k, bands that reach the bound are aligned with
the segment inside the band, and regions within k edits are reported.

Items of fewer than ``MIN_ITEM`` bytes allow no edit and share too few q-grams:
they are looked up whole, from each word on, and must end with a word.

Text and items are compared without case (ASCII and Latin-1 letters) and with
every run of other ASCII characters than letters and digits as one space.

A benchmark is an evaluation set: blocks of ``BLOCK_BYTES`` bytes of it are sent
to the tasks one after the other (one block, mostly).  Documents are never
shuffled; each is read whole where it is.  Work inside a task is numpy over
chunks of text: q-gram hashes, a bit table, a lookup of the few that pass.

Defined results: null and empty texts have no regions; items without id, or
without a letter, digit or other word character, are ignored; equal items are each
reported; rows are independent, so ties and repeated rows need no rule; an empty
benchmark marks nothing; the document's columns travel as one struct, so no name
clashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import common as C

Q = 12
SEGMENT = 100
#: Edits allowed per character of a segment.
EDIT_RATE = 0.06
#: Normalised bytes from which on an item is cut in segments; shorter ones are looked up whole.
MIN_ITEM = 20
BLOCK_BYTES = 2 << 20
_BAND = 16
_TABLE_BITS = 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def normalise(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, offset of each document in them, place in ``raw`` of each byte).

    A document ends with a zero byte, so no match crosses its end.
    """
    b = _FOLD[raw]
    upper = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    b[upper] += 32
    word = _WORD[b]
    first = np.zeros(len(b) + 1, bool)
    first[off] = True
    before = np.zeros(len(b), bool)  # a word byte of the same document stands before
    before[1:] = word[:-1]
    before &= ~first[:-1]
    stay = word | before  # of other runs the first byte, unless the document starts with them
    at = np.flatnonzero(stay)
    out = np.where(word[at], b[at], 0x20)
    ends = np.searchsorted(at, off[1:])
    out = np.insert(out, ends, 0)
    place = np.insert(at, ends, off[1:])
    return out, np.r_[0, ends + np.arange(1, len(off))], place


def grams(b: np.ndarray) -> np.ndarray:
    """Hash of the ``Q`` bytes from each place on."""
    n = len(b) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = np.concatenate([b, np.zeros(8, np.uint8)])
    eight = np.zeros(n + Q - 8, np.uint64)
    for k in range(8):
        eight |= p[k:k + len(eight)].astype(np.uint64) << np.uint64(8 * k)
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15) + eight[Q - 8:Q - 8 + n] * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Benchmark:
    """Segments of items and an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.item: list[int] = []
        segments: list[np.ndarray] = []
        short: list[tuple[bytes, int]] = []
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            b = normalise(raw, np.array([0, len(raw)]))[0][:-1]
            b = b[:-1] if len(b) and b[-1] == 0x20 else b
            b = b[1:] if len(b) and b[0] == 0x20 else b
            if len(b) < MIN_ITEM:
                if len(b):
                    short.append((b.tobytes(), item))
                continue
            n = max(1, -(-2 * (len(b) - SEGMENT) // SEGMENT) + 1) if len(b) > SEGMENT else 1
            for a in sorted({round(i * (len(b) - SEGMENT) / max(1, n - 1)) for i in range(n)}) if n > 1 else [0]:
                segments.append(b[a:a + SEGMENT])
                self.item.append(item)
        self.short: dict[int, tuple[np.ndarray, list[list[int]]]] = {}  # by length: texts in order, their items
        for n in sorted({len(s) for s, _ in short}):
            of_text: dict[bytes, list[int]] = {}
            for s, item in sorted(x for x in short if len(x[0]) == n):
                of_text.setdefault(s, []).append(item)
            self.short[n] = np.array(list(of_text), f"S{n}"), list(of_text.values())
        self.size = np.array([len(s) for s in segments], np.int64)
        self.edits = np.minimum((self.size * EDIT_RATE).astype(np.int64), (self.size - Q) // Q)  # the bound stays above 0
        self.bound = self.size + 1 - Q * (self.edits + 1)
        self.most = int(self.edits.max(initial=0))
        self.bytes = np.zeros((len(segments), SEGMENT), np.uint8)
        for s, x in zip(segments, self.bytes, strict=True):
            x[:len(s)] = s
        gram = [grams(s) for s in segments]
        flat = np.concatenate(gram) if gram else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(segments)), [len(g) for g in gram]) if gram else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in gram]) if gram else np.zeros(0, np.int64)
        by = np.argsort(flat, kind="stable")
        self.gram, first = np.unique(flat[by], return_index=True)
        self.first = np.r_[first, len(flat)]
        self.owner, self.place = owner[by], place[by]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.gram >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def bands(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, first diagonal) of the bands that reach the bound in normalised text."""
        g = grams(b)
        at = np.flatnonzero(self.table[(g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        i = np.searchsorted(self.gram, g[at])
        hit = self.gram[np.minimum(i, len(self.gram) - 1)] == g[at]
        at, i = at[hit], i[hit]
        n = self.first[i + 1] - self.first[i]
        k = np.repeat(self.first[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        segment = self.owner[k]
        diagonal = np.repeat(at, n) - self.place[k] + SEGMENT  # never negative
        band = diagonal // _BAND
        low = diagonal % _BAND < self.edits[segment]  # also in the band before, which reaches over
        keys = np.concatenate([band * len(self.size) + segment, (band[low] - 1) * len(self.size) + segment[low]])
        found, count = np.unique(keys, return_counts=True)
        segment = found % len(self.size)
        good = count >= self.bound[segment]
        return segment[good], (found[good] // len(self.size)) * _BAND - SEGMENT

    def align(self, b: np.ndarray, segment: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end in the text) of the best alignment of each segment inside its band.

        Column j of row i stands for text position i + diagonal + j: a step down a
        column is a match or substitution, to the left a deletion, to the right an
        insertion.  The text end is free, and so is its start.
        """
        wide = _BAND + 2 * self.most
        big = 1 << 12
        col = np.arange(wide)
        lead = diagonal - self.most // 2
        size = self.size[segment]
        score = np.zeros((len(segment), wide), np.int32)
        for i in range(int(size.max(initial=0))):
            live = i < size
            pos = lead[:, None] + i + col
            inside = (pos >= 0) & (pos < len(b))
            text = np.where(inside, b[np.clip(pos, 0, len(b) - 1)], 0)
            same = text == self.bytes[segment, i][:, None]
            new = score + np.where(text == 0, big, ~same)  # no path goes over a document's end
            new[:, :-1] = np.minimum(new[:, :-1], score[:, 1:] + 1)
            ahead = np.zeros_like(new)  # cost of inserting the text up to each column
            np.cumsum(1 + big * (text[:, 1:] == 0), axis=1, out=ahead[:, 1:])
            new = np.minimum.accumulate(new - ahead, axis=1) + ahead
            score = np.where(live[:, None], new, score).astype(np.int32)
        at = score.argmin(axis=1)
        return score[np.arange(len(segment)), at], lead + size + at

    def whole(self, b: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, 0) of the short items that stand as whole words in normalised text."""
        gap = (b == 0x20) | (b == 0)
        start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        for n, (texts, items) in self.short.items():
            at = start[start + n < len(b)]
            at = at[gap[at + n]]  # a shorter word may have ended before, and a document: then the bytes differ
            some = np.ascontiguousarray(b[at[:, None] + np.arange(n)]).view(f"S{n}").ravel()
            i = np.minimum(np.searchsorted(texts, some), len(texts) - 1)
            for k in np.flatnonzero(texts[i] == some).tolist():
                for item in items[i[k]]:
                    yield item, int(at[k]), int(at[k]) + n, 0

    def regions(self, b: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) in normalised text, the best one of each segment and place."""
        segment, diagonal = self.bands(b) if len(self.size) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for a in range(0, len(segment), 2000):
            s, d = segment[a:a + 2000], diagonal[a:a + 2000]
            edits, end = self.align(b, s, d)
            good = edits <= self.edits[s]
            for seg, e, k in zip(s[good].tolist(), end[good].tolist(), edits[good].tolist(), strict=True):
                yield self.item[seg], max(0, e - int(self.size[seg])), e, k
        yield from self.whole(b)


def _mark(items):
    region = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    kind = pa.list_(region)
    held: list[Benchmark] = []

    def run(batches):
        if not held:
            held.append(Benchmark(items.value))
        for batch in batches:
            for t in C.chunks(batch):
                raw, off = C.text_buffer(t.column("text"))
                out: list[list[dict]] = [[] for _ in range(t.num_rows)]
                if len(raw):
                    b, begin, place = normalise(raw, off)
                    lead = np.cumsum((raw & 0xC0) != 0x80)  # code points up to and with each byte
                    for item, a, e, k in held[0].regions(b):
                        doc = int(np.searchsorted(begin, e - 1, "right")) - 1
                        a = max(a, int(begin[doc]))
                        x, y = int(place[a]), int(place[min(e, len(place) - 1)])
                        base = int(lead[off[doc] - 1]) if off[doc] else 0
                        out[doc].append({"item_id": item, "start": int(lead[x]) - 1 - base, "end": (int(lead[y]) - 1 if y < len(raw) else int(lead[-1])) - base, "edits": k})
                found = [list({(r["item_id"], r["start"], r["end"]): r for r in sorted(rs, key=lambda r: (r["start"], r["end"], r["item_id"], -r["edits"]))}.values()) for rs in out]
                regions = pa.array(found, kind)
                if "regions" in t.column_names:  # blocks before this one
                    regions = pa.array([(x or []) + y for x, y in zip(t.column("regions").to_pylist(), found, strict=True)], kind)
                yield from pa.table({"_row": t.column("_row"), "text": t.column("text"), "regions": regions}).to_batches()

    return run


def mark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns _row (all columns of ``docs`` as a struct) and regions (item_id, start, end, edits; code points)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, math.ceil(C.text_bytes(benchmark) / BLOCK_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    d = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
    region = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())])
    schema = T.StructType([*d.schema.fields, T.StructField("regions", T.ArrayType(region))])
    for block in range(blocks):
        if block:
            d = C.keep(d, "decontaminate-block")
        some = items.filter(F.col("block") == block).select("item_id", "text").collect()  # about BLOCK_BYTES
        items_here = spark.sparkContext.broadcast(sorted((r.item_id, r.text) for r in some if r.text is not None and r.item_id is not None))
        d = d.mapInArrow(_mark(items_here), schema)
    return d.select("_row", "regions")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_regions, n_items, items (ids, ascending), regions, contaminated."""
    items = F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["item_id"])))
    return mark(docs, benchmark).select(
        F.col("_row.doc_id").cast("long").alias("doc_id"), F.size("regions").cast("long").alias("n_regions"), F.size(items).cast("long").alias("n_items"),
        items.alias("items"), "regions", (F.size("regions") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark region, with their columns."""
    return mark(docs, benchmark).filter(F.size("regions") == 0).select("_row.*")
