"""Line dedup by winnowing over line hashes.

Lines are compared without white space at their ends; lines without a word are
left out of the comparison and stay.  Later copies of equal runs of lines that
hold at least ``min_words`` words go, as far as the runs are equal: a line goes
if it lies in such a run that also occurs at an earlier place (smaller doc_id, or
same document, earlier line).

Plan
1. Winnow: a window is a shortest run of whole lines with ``min_words`` words,
   from any line on or up to any line; a long line is one by itself.  Each selects
   its line of smallest hash (the last of equals).  Two equal windows select the
   same line, so a repeated run of ``min_words`` words has a shared fingerprint.
2. Join: places of fingerprints meet; only those that occur at two places go on
   (min and max of the place, so a hot line costs a row per map task).
3. Extend: around a repeated fingerprint the run is compared to both sides, in
   the form of the windows that selected it, whose hashes cover the lines left
   and right of it.  The windows from each line of a maximal equal run that end in
   it, and those up to each line that begin in it, cover it whole.  All windows of a
   hash meet their earliest place; no pairs are made.  Fingerprints and windows with
   a large share of all rows are joined apart, by broadcast.
4. Cut: windows at later places go back to their documents.

Defined results: null and empty texts have no lines and stay as they are; null
doc_id sorts first; rows with equal doc_id are ordered by their text's hash, and
rows equal in both are one document, each returned; extra columns are kept by
``deduplicated`` (as one struct, so no name clashes) and ignored by ``line_dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import common as C

MIN_WORDS = 50
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOWS = "k long, dk long, fp long, at int, h1 long, h2 long, start int, n int"


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)


def line_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (from the first word to the last), number of words and document of each line with a word."""
    start, end, doc = C.words(raw, off)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    line = np.searchsorted(np.flatnonzero(raw == 0x0A), start)
    new = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:], len(start)]
    return start[new], end[last - 1], last - new, doc[new]


def windows(words: np.ndarray, doc: np.ndarray, h: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, line after the last, selected line) of all windows; ``h`` orders lines."""
    total = np.r_[0, np.cumsum(words)]
    first = np.arange(len(words))
    stop = np.searchsorted(total, total[:-1] + min_words)  # total[stop] is the first to hold enough
    ok = stop <= len(words)
    first, stop = first[ok], stop[ok]
    ok = doc[first] == doc[stop - 1]
    first, stop = first[ok], stop[ok]
    return first, stop, _selected(first, stop, h)


def windows_to(words: np.ndarray, doc: np.ndarray, h: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `windows`, of the shortest runs that end at each line, without those that `windows` has."""
    total = np.r_[0, np.cumsum(words)]
    stop = np.arange(1, len(words) + 1)
    first = np.searchsorted(total, total[1:] - min_words, "right") - 1  # total[first] is the last to leave enough
    ok = first >= 0
    first, stop = first[ok], stop[ok]
    ok = (doc[first] == doc[stop - 1]) & (total[stop - 1] - total[first] >= min_words)  # enough without the last line: no window of `windows`
    first, stop = first[ok], stop[ok]
    return first, stop, _selected(first, stop, h)


def _selected(first: np.ndarray, stop: np.ndarray, h: np.ndarray) -> np.ndarray:
    chosen = first.copy()
    for k in range(1, int((stop - first).max(initial=0))):
        more = np.flatnonzero(first + k < stop)
        better = h[first[more] + k] <= h[chosen[more]]
        chosen[more[better]] = first[more[better]] + k
    return chosen


def _winnow(min_words: int):
    names = ("k", "dk", "fp", "at", "h1", "h2", "start", "n")
    one, two = C.SpanHash(21), C.SpanHash(22)

    def run(batches):
        for batch in batches:
            for t in C.chunks(batch):
                raw, off = C.text_buffer(t.column("text"))
                start, end, words, doc = line_spans(raw, off)
                h = one(raw, start, end)
                first, stop, chosen = (np.r_[a, b] for a, b in zip(windows(words, doc, h, min_words), windows_to(words, doc, h, min_words), strict=True))
                if not len(first):
                    continue
                up, down = _powers(_BASE, len(h)), _powers(_INVERSE, len(h))
                sums = [np.r_[np.uint64(0), np.cumsum(x * up[:-1], dtype=np.uint64)] for x in (h, two(raw, start, end))]
                hashes = [C.mix((s[stop] - s[first]) * down[first] + (stop - first).astype(np.uint64)) for s in sums]
                d = doc[first]
                base = np.searchsorted(doc, d)  # lines are numbered in their document
                values = (t.column("k").to_numpy()[d], t.column("dk").to_numpy()[d], h[chosen].view(np.int64), (chosen - base).astype(np.int32),
                          hashes[0].view(np.int64), hashes[1].view(np.int64), (first - base).astype(np.int32), (stop - first).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names)

    return run


def later_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """k, dk, runs (start, n: lines with a word, counted in the document) of documents with later copies.

    ``docs`` has k, dk and text.
    """
    w = C.keep(docs.select("k", "dk", "text").mapInArrow(_winnow(min_words), _WINDOWS), "line-windows")
    total = w.count()
    place, count = F.struct("k", "dk", "at"), F.count(F.lit(1)).alias("n")
    repeated = C.keep(w.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b"), count).filter("a <> b").select("fp", "n"), "line-fingerprints")
    near = C.keep(C.meet(w.withColumnRenamed("n", "lines"), repeated, ["fp"], total).select("k", "dk", "h1", "h2", "start", "lines"), "line-near")
    where = F.struct("k", "dk", "start")
    firsts = C.keep(near.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("last"), count).filter("first <> last").drop("last"), "line-firsts")
    later = C.meet(near, firsts, ["h1", "h2"], total).filter(where > F.col("first"))
    return later.groupBy("k", "dk").agg(F.collect_list(F.struct("start", F.col("lines").alias("n"))).alias("runs"))  # of one document


def cut_text(text: bytes, runs: list[dict] | None) -> tuple[bytes, int, int]:
    """(kept text, lines with a word, of these removed)."""
    lines = text.split(b"\n")
    solid = [i for i, x in enumerate(lines) if x.strip()]
    if not runs:
        return text, len(solid), 0
    gone = np.zeros(len(solid) + 1, np.int64)
    for r in runs:
        gone[r["start"]] += 1
        gone[r["start"] + r["n"]] -= 1
    drop = {solid[i] for i in np.flatnonzero(np.cumsum(gone)[:-1]).tolist()}
    return b"\n".join([x for i, x in enumerate(lines) if i not in drop]), len(solid), len(drop)


def _joined(docs: DataFrame, columns: list, min_words: int) -> DataFrame:
    d = docs.select(*columns, F.col("text").cast("string").alias("text"), C.id_key().alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("dk"))
    return d.join(later_runs(d, min_words), ["k", "dk"], "left")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_lines (with a word), n_removed, kept_sha256, kept_text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * keep_text)

    def run(batches):
        for batch in batches:
            for t in C.chunks(batch):
                cut = [cut_text(x, r) for x, r in zip(C.texts(t.column("text")), t.column("runs").to_pylist(), strict=True)]
                out = {"doc_id": t.column("doc_id").combine_chunks(), "n_lines": [c[1] for c in cut], "n_removed": [c[2] for c in cut], "kept_sha256": [hashlib.sha256(c[0]).hexdigest() for c in cut]}
                yield pa.RecordBatch.from_pydict(out | ({"kept_text": [c[0].decode() for c in cut]} if keep_text else {}), schema)

    rows = _joined(docs, [F.col("doc_id").cast("long").alias("doc_id")], min_words).select("doc_id", "text", "runs")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs cut from text (and n_chars, where it is a column, counted anew).

    Documents of which nothing with a word is left go: all they held stands earlier.
    """
    rows = _joined(docs, [F.struct(*docs.columns).alias("_row")], min_words).select("_row", "text", "runs")
    schema = T.StructType([rows.schema["_row"], T.StructField("_text", T.StringType())])

    def run(batches):
        for batch in batches:
            for t in C.chunks(batch):
                cut = [cut_text(x, r) for x, r in zip(C.texts(t.column("text")), t.column("runs").to_pylist(), strict=True)]
                stay = pa.array([not n or n < lines for _, lines, n in cut])
                new = pa.array([c[0].decode() if c[2] else None for c in cut], pa.string())  # null: unchanged
                yield from pa.table({"_row": t.column("_row"), "_text": new}).filter(stay).to_batches()

    out = rows.mapInArrow(run, schema)
    text = F.coalesce("_text", "_row.text")
    new = {"text": text, "n_chars": F.when(F.col("_text").isNull(), F.col("_row.n_chars")).otherwise(F.length(text)).cast("long")} if "n_chars" in docs.columns else {"text": text}
    return out.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
