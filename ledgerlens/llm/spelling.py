"""Groups of spelling variants: words one edit apart, each led to its most frequent form.

Two words are near if one inserted, deleted or replaced code point makes one of
the other, that is, if the code points they share from the front and those they
share from the back are together at least as many as the longer one's less one.

Plan
1. Tokens are counted by word (a partial sum per task before the shuffle); the
   words of enough occurrences are written once.
2. Candidates: the longer word of a pair, of m code points, is cut in three
   segments.  The edit lies in one of them, so what stands before and behind that
   segment is equal in both; words meet by (m, segment, front, back), hashed.
   Every word has six such keys: three as a longer, three as a shorter one.
3. Tiles: rows are sorted by key and compared in square blocks, as padded matrices
   of code points, forward for the common front and backward for the common back.
   A key of many words is dealt in blocks of about ``BLOCK`` rows, each pair of
   blocks to a task of its own, so no task holds a key whole.  A pair counts only
   in the segment of its first difference, that is once.
4. Each tile returns a row per word with its number of near words and the best of
   them; these are merged by word.  No pairs leave a tile.
5. Forms lead to words of at least ``ratio`` times the count, so chains end after
   few steps; roots are found by doubling them.

Comparing blocks is quadratic in the words of one key.  A key holds all but a
third of its word, so its rows differ in that third only.

Defined results: null text has no words; tokens that are null or shorter than
asked for are left out; rows with equal or null doc_id count like others; of near
words with equal counts the first in code-point order is the form; an empty table
gives no rows; extra columns are ignored whatever their names.  Words of any
length are compared whole; tiles of long words have fewer rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
SEGMENTS = 3
#: Rows of a key in one block.
BLOCK = 1024
#: Rows of a tile's side, and code points that a tile compares at once.
TILE, CELLS = 64, 1 << 22
#: Candidate rows of one partition.
ROWS_PER_PART = 200_000
_PAD = np.uint32(0xFFFFFFFF)


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id and word of each run of letters (ASCII, U+00C0 to U+00FF), A-Z lower-cased only."""
    upper = "".join(map(chr, range(65, 91)))
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), upper, upper.lower())
    return docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), 0)).alias("word"))


def word_counts(found: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words long and frequent enough."""
    return found.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count).select("word", "n")


def _keys(words: DataFrame) -> DataFrame:
    """word, n, m (length of the longer), segment, key."""
    size = F.length("word")
    rows = []
    for more in (0, 1):
        m = size + more
        for t in range(SEGMENTS):
            front, back = F.floor(m * t / SEGMENTS).cast("int"), (m - F.floor(m * (t + 1) / SEGMENTS)).cast("int")
            key = F.xxhash64(m, F.lit(t), F.substring("word", F.lit(1), front), F.substring("word", size - back + 1, back))
            rows.append(F.struct(m.cast("int").alias("m"), F.lit(t).alias("segment"), key.alias("key")))
    return words.select("word", "n", F.explode(F.array(*rows)).alias("_r")).select("word", "n", "_r.*")


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows with the pair of blocks (lo, hi) they meet in, and their own block."""
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_g")).filter(F.col("_g") > BLOCK)
    rows = rows.join(hot.select("key", F.ceil(F.col("_g") / BLOCK).cast("int").alias("blocks")), "key", "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word", F.lit(5)), F.coalesce("blocks", F.lit(1))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return rows.select("m", "segment", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "word", "n")


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, padded with 0, forward and backward."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    forward = np.zeros((len(words), int(size.max(initial=0)) + 1), np.uint32)  # the last column differs always
    backward = np.zeros_like(forward)
    forward[row, col] = flat
    backward[row, np.repeat(size, size) - 1 - col] = flat
    return forward, backward


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading columns in which each row of ``a`` equals each row of ``b`` (0: padding)."""
    b = np.where(b == 0, _PAD, b)
    return np.argmin(a[:, None, :] == b[None, :, :], axis=2)


def near_pairs(words: list[str], group: np.ndarray, block: np.ndarray, crossing: np.ndarray, m: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i < j) of near words that lie in one group.

    Rows are in order of ``group``.  Where ``crossing``, a group is a pair of different
    blocks and only rows of different ones are compared.
    """
    size = np.array([len(w) for w in words])
    found = []
    at, n = 0, len(words)
    cuts = [0]
    while at < n:  # tiles of fewer rows where words are long
        rows = max(1, min(TILE, int((CELLS / (int(size[at:at + TILE].max()) + 1)) ** 0.5)))
        at = min(n, at + rows)
        cuts.append(at)
    for x in range(len(cuts) - 1):
        a, b = cuts[x], cuts[x + 1]
        for y in range(x, len(cuts) - 1):
            c, d = cuts[y], cuts[y + 1]
            if y > x and group[c] != group[b - 1]:
                break
            ok = (group[a:b, None] == group[None, c:d]) & (np.arange(a, b)[:, None] < np.arange(c, d)[None, :])
            ok &= ~crossing[a:b, None] | (block[a:b, None] != block[None, c:d])
            ok &= np.maximum(size[a:b, None], size[None, c:d]) == m[a:b, None]
            if not ok.any():
                continue
            mats = matrices(words[a:b] + words[c:d])
            front, back = (common(z[:b - a], z[b - a:]) for z in mats)
            ok &= front + back >= m[a:b, None] - 1
            low, high = (m[a:b] * segment[a:b]) // SEGMENTS, (m[a:b] * (segment[a:b] + 1)) // SEGMENTS
            first = np.minimum(front, m[a:b, None] - 1)
            ok &= (first >= low[:, None]) & (first < high[:, None])
            i, j = np.nonzero(ok)
            found.append((i + a, j + c))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_PARTIAL = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _best(t: pa.Table) -> pa.RecordBatch:
    """Each word's number of near words and the best of them, from rows of whole groups."""
    words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
    key = [t.column(c).to_numpy() for c in ("key", "lo", "hi", "m", "segment")]
    group = np.cumsum(reduce(np.logical_or, [np.r_[False, k[1:] != k[:-1]] for k in key]))
    i, j = near_pairs(words, group, t.column("block").to_numpy(), key[1] != key[2], key[3].astype(np.int64), key[4].astype(np.int64))
    order = sorted(set(i.tolist()) | set(j.tolist()), key=lambda k: (-n[k], words[k]))
    rank = np.full(len(words), len(words))
    rank[order] = np.arange(len(order))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for a, b in ((i, j), (j, i)):
        np.add.at(near, a, 1)
        np.minimum.at(best, a, rank[b])
    rows = np.flatnonzero(near)
    chosen = [order[k] for k in best[rows].tolist()]
    return pa.RecordBatch.from_arrays([pa.array([words[r] for r in rows.tolist()], pa.string()), pa.array(near[rows]), pa.array(n[chosen] if chosen else np.zeros(0, np.int64)), pa.array([words[c] for c in chosen], pa.string())], schema=_PARTIAL)


def _compare(batches):
    """Whole groups of each batch; a group that goes on in the next batch waits for it."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        last = t.num_rows
        if last:
            k = [t.column(c).to_numpy() for c in ("m", "key", "lo", "hi")]
            differs = reduce(np.logical_or, [x != x[-1] for x in k])
            last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if last:
            yield _best(t.slice(0, last))
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield _best(rest)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form_n, form: of each word with near words their number and the most frequent one."""
    total = words.count()
    parts = C.parts_for(words.sparkSession, 2 * SEGMENTS * total, ROWS_PER_PART)
    order = ["m", "key", "lo", "hi", "segment"]
    rows = _tiled(_keys(words)).repartition(parts, "key", "lo", "hi").sortWithinPartitions(*order)
    near = rows.mapInArrow(_compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("a"), F.col("best").alias("b")))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", (-F.col("_b.a")).alias("form_n"), F.col("_b.b").alias("form"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root of links (word, form) that end: each round doubles the steps taken."""
    cur = C.keep(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        far = cur.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        cur = C.keep(cur.join(far, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")), "spelling-roots")
        if cur.filter("_moved").isEmpty():
            return cur.select("word", "root")
        cur = cur.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of distinct words (word, n).

    ``form`` is the most frequent near word where it has at least ``ratio`` (2 or more) times
    the count, else null; ``root`` is the end of the chain of forms, or the word itself.
    """
    if ratio < 2:
        raise ValueError("ratio of at least 2, or chains of forms need not end")
    words = C.keep(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    found = C.keep(words.join(near_words(words), "word", "left"), "spelling-near")
    strong = F.col("form_n") >= ratio * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n"))
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
