"""Shared helpers: reading tables, byte-level words of Arrow text columns, packed integer lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import materialize, scratch_path

#: Text handled at once inside a task (a single longer document is handled alone).
CHUNK_BYTES = 4 << 20
#: Bytes hashed at once.
HASH_BYTES = 1 << 20
#: Stands for a null id wherever ids are ordered or joined; null ids sort first.
NULL_ID = -(1 << 63)

#: Bytes between words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write under the shared checkpoint folder and read back (cuts lineage)."""
    return materialize(df, f"llm-{name}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application under the cluster's shared checkpoint folder (``session.clean_scratch`` deletes it)."""
    return scratch_path(spark, f"llm-{name}")


def id_key(column: str = "doc_id") -> Column:
    """The id as a non-null long (null: ``NULL_ID``)."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts; one aggregate, used to size partitions and buckets."""
    row = docs.agg(F.sum(F.octet_length(F.col(column)).cast("long")).alias("n")).first()
    return int(row["n"] or 0)


def parts_for(spark: SparkSession, total: int, each: int) -> int:
    """Partitions so that each holds about ``each`` units, at least the session's default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / each))


#: Keys that may each hold more than this share of all rows are fewer than its inverse.
HOT_SHARE = 1 / 1000


def meet(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keys`` (distinct ``on``, their number of rows ``n``, others), hot keys apart.

    A key with more than ``HOT_SHARE`` of the ``total`` rows is hot: there are fewer than
    1 / HOT_SHARE of them, so they are broadcast and their rows are not shuffled; what is
    left joins by a shuffle in which no key is large.
    """
    is_hot = F.col("n") > total * HOT_SHARE
    hot = F.broadcast(keys.filter(is_hot).drop("n"))
    rest = rows.join(F.broadcast(keys.filter(is_hot).select(*on)), on, "left_anti").join(keys.filter(~is_hot).drop("n"), on)
    return rows.join(hot, on).unionByName(rest)


def chunks(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Slices of ``batch`` whose texts hold about ``limit`` bytes (never less than a row)."""
    t = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
    if not t.num_rows:
        return
    size = pc.fill_null(pc.binary_length(t.column(text)), 0).to_numpy().astype(np.int64)
    part = (np.cumsum(size) - size) // limit
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(at, np.r_[at[1:], len(part)], strict=True):
        yield t.slice(a, b - a)


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of length rows + 1) of a text column; null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    a = pc.fill_null(a, "").cast(pa.large_string())
    _, offsets, data = a.buffers()
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[a.offset:a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def texts(column) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    raw, off = text_buffer(column)
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``; no run crosses a document end in ``off``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    prev = np.zeros(n, bool)
    prev[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~prev | edge[:-1]))
    nxt = np.zeros(n, bool)
    nxt[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~nxt | edge[1:])) + 1
    return starts, ends


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mix of 64-bit hashes (the splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class SpanHash:
    """64-bit polynomial hashes of byte spans: a random value per byte, a random odd base."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = np.uint64(int(rng.integers(0, 1 << 63)) * 2 + 1)
        self.powers = np.ones(1, np.uint64)

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = np.zeros(len(size), np.uint64)
        if not len(size):
            return out
        if (most := int(size.max())) >= len(self.powers):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * most, self.base, np.uint64)], dtype=np.uint64)
        part = (np.cumsum(size) - size) // HASH_BYTES  # a slice of spans at a time
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            n = size[a:b]
            first = np.cumsum(n) - n
            rel = np.arange(int(first[-1] + n[-1])) - np.repeat(first, n)
            values = self.powers[rel]
            rel += np.repeat(starts[a:b], n)
            values *= self.table[raw[rel]]
            out[a:b] = np.add.reduceat(values, first)
        return mix(out)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the words (runs of bytes other than 0x20, 0x09-0x0D)."""
    starts, ends = spans(~SEPARATOR[raw], off)
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of every ``size`` consecutive values, by doubling; empty if too few."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    have, acc, done = 1, h, None
    taken, power = 0, np.uint64(base | 1)
    left = size
    with np.errstate(over="ignore"):
        while left:
            if left & 1:  # prepend what is done: done covers `taken` values, acc the next `have`
                n = len(h) - taken - have + 1
                done = acc[:n].copy() if done is None else done[:n] * power + acc[taken:taken + n]
                taken += have
            left >>= 1
            if left:
                acc = acc[:len(acc) - have] * power + acc[have:]
                have *= 2
                power = power * power
    return mix(done)


def pack_small(values: np.ndarray) -> bytes:
    """Non-negative integers as bytes: 255 stands for "add 255 and go on"."""
    q, r = np.divmod(values.astype(np.int64), 255)
    out = np.full(int(q.sum()) + len(q), 255, np.uint8)
    out[np.cumsum(q + 1) - 1] = r
    return out.tobytes()


def unpack_small(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    total = np.cumsum(b.astype(np.int64))[b != 255]
    return np.diff(total, prepend=0)


def grouped_deltas(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Differences of ascending values, starting anew in each run of ``counts`` values."""
    d = np.diff(values, prepend=0)
    first = np.cumsum(counts) - counts
    d[first] = values[first]
    return d


def undo_deltas(deltas: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(deltas)
    first = np.cumsum(counts) - counts
    return total - np.repeat(total[first] - deltas[first], counts)
