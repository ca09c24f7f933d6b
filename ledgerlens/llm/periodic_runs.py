"""Periodic runs of words by maximal pairs in a bottom-up LCP-interval tree.

A run is a stretch of words with smallest period q (words q apart are equal), of
at least ``max(least, times * q)`` words, that no neighbouring word extends
keeping period q.

Two places of a word sequence w are a maximal pair if the words before them
differ and the words behind them differ.  Let d be their distance and
d * (times - 1) <= len(w): then the stretch from the first place to the end of
the second has period d, both neighbours break it, and it is long enough; so it
is a run, without extending anything.  Every run is found so, by its first place
and the one a period later.

Plan, for the documents of a chunk of text together (no shuffle)
1. Words become numbers.  Only words inside short windows (five words, for 6
   and 4) that recur in their document can lie in a run; the others are left out, with a
   symbol of its own in every gap.  A bitmap of window hashes over-selects at
   most; all later steps compare exactly.
2. Suffix array of what is left by prefix doubling: only tied suffixes are sorted
   again.  The ranks of each doubling give the longest common prefixes of
   neighbours in the array.
3. Bottom-up, each LCP interval merges the lists of its children, the shorter
   into the longer.  A list has the interval's places in order, each in the class
   of its left word.  A place is paired with its neighbours in the other child's
   list, if these are of another class and near enough.  Other places of the
   interval need no test: with three periods or more, one between the two places
   of a run would make a smaller period.

Defined results: null, empty and wordless texts have no runs; rows are
independent, so ties, repeated rows, null and repeated ids need no rule; equal
longest runs go by smaller start, then smaller period; extra columns are ignored
whatever their names.  A task holds a chunk of texts (or a single longer one) and
about 150 bytes for each word of it that stands in recurring windows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C

LEAST, TIMES = 6, 4
#: Places of a shorter list inserted one by one; more are sorted in.
_FEW = 16


def recurring(ids: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of ``size`` words that (by its hash) recurs in their document."""
    n = len(ids)
    out = np.zeros(n + 1, np.int64)
    if n >= size:
        with np.errstate(over="ignore"):
            h = C.rolling(C.mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), size, 0x2545F4914F6CDD1D)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
            h = C.mix(h ^ (doc[:len(h)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        whole = np.flatnonzero(doc[:n - size + 1] == doc[size - 1:])
        h = h[whole]
        bits = max(10, int(8 * len(h)).bit_length())
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        seen = np.bincount(slot, minlength=1 << bits) > 1
        twice = seen[slot]
        whole, h = whole[twice], h[twice]
        order = np.argsort(h)
        equal = h[order][1:] == h[order][:-1]
        both = np.r_[False, equal] | np.r_[equal, False]
        at = whole[order[both]] if len(h) else whole
        np.add.at(out, at, 1)
        np.add.at(out, at + size, -1)
    return np.cumsum(out[:-1]) > 0


def suffixes(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix with the one before) of symbols whose last one is unique."""
    n = len(sym)
    order = np.argsort(sym, kind="stable")
    new = np.r_[True, sym[order][1:] != sym[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, span = [rank], 1
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(tied):
        # Tied suffixes go on within the array: its last symbol is unique, so none of them reaches it.
        key = (rank[tied] << np.int64(32)) | rank[tied + span]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        group = key >> np.int64(32)
        k = np.arange(len(key))
        first = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], k, 0))
        same = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], k, 0))
        rank = rank.copy()
        rank[tied] = group + same - first
        levels.append(rank)
        span *= 2
        size = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
        tied = tied[np.repeat(size, size) > 1]
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    for k in range(len(levels) - 2, -1, -1):
        equal = levels[k][a] == levels[k][b]
        step = np.where(equal, 1 << k, 0)
        lcp[1:] += step
        a += step
        b += step
    return sa, lcp


def shortest_common(least: int, times: int) -> int:
    """Words that the two places of a run's pair share at least: max(least, times q) - q over all periods q."""
    return min(least - least // times, (times - 1) * (least // times + 1))


def maximal_pairs(sa: list[int], lcp: list[int], place: list[int], left: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs: maximal pairs of a distance that their length allows.

    ``place`` is a suffix's place in the text, ``left`` the class of the word before it.
    """
    out = []
    shortest = shortest_common(least, times)

    def merged(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        far = depth // (times - 1)
        for n, x in enumerate(b):
            k = bisect_left(a, x)
            near = []
            if k and (not n or b[n - 1] < a[k - 1]):  # no place of its own list in between
                near.append((a[k - 1], x))
            if k < len(a) and (n + 1 == len(b) or a[k] < b[n + 1]):
                near.append((x, a[k]))
            for i, j in near:
                d = place[j] - place[i]
                if d <= far and depth + d >= least and left[i] != left[j]:
                    out.append((place[i], depth + d, d))
        if len(b) <= _FEW:
            for x in b:
                insort(a, x)
        else:
            a += b
            a.sort()
        return a

    open_nodes: list[tuple[int, list[int]]] = []  # (depth, places so far), deeper ones later
    for x, depth in zip(sa, [*lcp[1:], 0], strict=True):
        node = [x]
        while open_nodes and open_nodes[-1][0] >= depth:
            at, places = open_nodes.pop()
            node = merged(places, node, at)
            if at == depth:
                break
        if depth >= shortest:
            open_nodes.append((depth, node))
    return out


def find_runs(ids: np.ndarray, off: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; starts count from the first document's first word."""
    inside = recurring(ids, off, shortest_common(least, times))
    at = np.flatnonzero(inside)
    if not len(at):
        return []
    doc = np.searchsorted(off, at, "right") - 1
    # A gap behind each stretch, with a symbol of its own; equal words of different documents differ.
    ends = np.r_[(at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]), True]
    pair = np.unique(doc * np.int64(int(ids.max()) + 1) + ids[at], return_inverse=True)[1]
    new = np.arange(len(at)) + np.r_[0, np.cumsum(ends)[:-1]]
    n = len(at) + int(ends.sum())
    sym = np.zeros(n, np.int64)
    gap = np.ones(n, bool)
    gap[new] = False
    sym[new] = pair
    sym[gap] = int(pair.max()) + 1 + np.arange(int(gap.sum()))
    place = np.full(n, -1, np.int64)
    place[new] = at
    left = np.r_[-1 - n, sym[:-1]]
    sa, lcp = suffixes(sym)
    return sorted(maximal_pairs(sa.tolist(), lcp.tolist(), place.tolist(), left.tolist(), least, times), key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run has behind its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_runs, the longest run, digests, runs, collapsed_text.

    The longest run is ``start``, ``length``, ``period`` and ``exponent_milli`` (null
    without a run); ``runs`` has all by start and period.  ``collapsed_text`` keeps the words
    (joined by a blank) that no run has behind its first period; both only with ``keep_text``.
    """
    if not 3 <= times <= least:
        raise ValueError("need 3 <= times <= least")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli"]
    schema = pa.schema([(c, pa.int64()) for c in names] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())] + [("runs", run_type), ("collapsed_text", pa.string())] * keep_text)

    def run(batches):
        for batch in batches:
            for t in C.chunks(batch):
                words = [x.split() for x in C.texts(t.column("text"))]
                number = defaultdict(count().__next__)
                off = np.cumsum([0, *map(len, words)])
                ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(off[-1]))
                found = [[] for _ in words]
                for start, length, period in find_runs(ids, off, least, times):
                    d = int(np.searchsorted(off, start, "right")) - 1
                    found[d].append((start - int(off[d]), length, period))
                out = {name: [] for name in schema.names}
                out["doc_id"] = t.column("doc_id").combine_chunks()
                for w, runs in zip(words, found, strict=True):
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                    text = b" ".join(kept_words(w, runs))
                    row = (len(w), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                           hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
                    for name, value in zip(schema.names[1:], (*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], text.decode()) if keep_text else row, strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema)

    types = ", ".join(f"{c} long" for c in names) + ", runs_sha256 string, collapsed_sha256 string"
    if keep_text:
        types += ", runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, types)
