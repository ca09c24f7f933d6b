"""Token-id files in Simple-8b word-aligned coding.

File: words of 64 bits, little endian, in blocks of up to ``BLOCK`` ids; then
per block its first word (u64) and number of ids (u64); then per document its id
(i64) and number of ids (u64); then a trailer: numbers of words, blocks and
documents (u64 each), crc32 of all before it (u64), ``MAGIC`` (8 bytes).

A word's top four bits select how many ids of how many bits the other 60 hold
(``WIDTHS``); selector 0 is an escape: the next word holds one whole 64-bit id.
A word takes as many of the next ids as fit; words do not cross blocks, so
blocks decode independently, all words of a selector at once.

Documents are dealt by ranges of doc_id, so file order is id order and a
document's start is the sum over earlier files plus that within its own.

Defined results: null and empty text give the end id alone; null doc_id sorts
first; rows with equal doc_id are each written, ordered by their text's hash;
an empty table gives no file and no row; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import common as C
from ledgerlens.llm import part_files

BLOCK = 4096
MAGIC = b"S8BIDS01"
#: Bits per id of selectors 1, 2, ...; a word holds 60 // bits ids.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_COUNTS = tuple(60 // b for b in WIDTHS)
_NARROWEST = np.array(WIDTHS, np.uint8)[np.searchsorted(1 << np.array(WIDTHS), np.arange(1 << 16), "right")]
#: Text of one file, and words a task remembers (more are met in a chunk).
FILE_BYTES = 16 << 20
WORDS_KEPT = 600_000
#: Text encoded at once; the more, the fewer of its words are new.
WRITE_BYTES = 8 << 20


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, ids of each block) of unsigned ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    bits = _NARROWEST[np.minimum(ids, np.uint64(0xFFFF)).astype(np.uint16)]  # the narrowest width that holds the id
    wide = np.flatnonzero(ids >> np.uint64(16))
    for w in (*WIDTHS[::-1], 0):  # the others one by one; 61: none holds it
        bits[wide] = np.where(ids[wide] >> np.uint64(w), bits[wide], w) if w else np.where(ids[wide] >> np.uint64(60), 61, bits[wide])
    block = np.arange(0, n, BLOCK)
    left = np.minimum(BLOCK, n - block)
    room = np.minimum(np.repeat(left, left) - np.arange(n) % BLOCK, 60).astype(np.uint8)
    select = np.zeros(n, np.uint8)  # 0: escape
    most = {1: bits}  # widest id of the next c
    def widest(c: int) -> np.ndarray:
        if c not in most:
            a = widest(half := (c + 1) // 2)
            most[c] = a.copy()
            if n > c - half:
                np.maximum(a[:n - (c - half)], a[c - half:], out=most[c][:n - (c - half)])
        return most[c]
    for s in range(len(WIDTHS), 0, -1):  # the last to fit, the most ids, wins
        fits = (widest(_COUNTS[s - 1]) <= WIDTHS[s - 1]) & (room >= _COUNTS[s - 1])
        select[fits] = s
    step = np.array((1, *_COUNTS), np.int64)[select]
    at, ends, taken = block.copy(), block + left, []
    while len(at):  # all blocks go forward by a word
        taken.append(at)
        at = at + step[at]
        live = at < ends
        at, ends = at[live], ends[live]
    first = np.sort(np.concatenate(taken))
    chosen = select[first]
    size = np.where(chosen == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(chosen):
        f, p = first[chosen == s], place[chosen == s]
        if s == 0:
            words[p + 1] = ids[f]
            continue
        v = np.full(len(f), np.uint64(int(s) << 60))
        for k in range(_COUNTS[s - 1]):
            v |= ids[f + k] << np.uint64(k * WIDTHS[s - 1])
        words[p] = v
    return words, place[np.searchsorted(first, block)].astype(np.uint64), left.astype(np.uint64)


def unpack(words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ids (u64) of all blocks of a packed array of words."""
    top = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # the word after an escape, whatever its bits
    at = 0
    for e in np.flatnonzero(top == 0).tolist():
        if e >= at:
            raw[e + 1] = True
            at = e + 2
    if len(words) and (top > len(WIDTHS))[~raw].any():
        raise ValueError("unknown selector")
    held = np.array((1, *_COUNTS), np.int64)[np.where(raw, 0, np.minimum(top, len(WIDTHS)))]
    held[raw] = 0
    place = np.cumsum(held) - held
    out = np.zeros(int(held.sum()), np.uint64)
    if int(counts.sum()) != len(out) or (len(starts) and not np.array_equal(place[starts.astype(np.int64)], np.cumsum(counts.astype(np.int64)) - counts.astype(np.int64))):
        raise ValueError("block index and words disagree")
    for s in np.unique(top[~raw]):
        at = np.flatnonzero((top == s) & ~raw)
        if s == 0:
            out[place[at]] = words[at + 1]
            continue
        bits = WIDTHS[s - 1]
        mask = np.uint64((1 << bits) - 1)
        for k in range(_COUNTS[s - 1]):
            out[place[at] + k] = (words[at] >> np.uint64(k * bits)) & mask
    return out


class TokenFile:
    """Appends documents' ids to an output stream."""

    def __init__(self, stream):
        self.stream, self.crc, self.words = stream, 0, 0
        self.starts, self.counts, self.docs, self.sizes = [], [], [], []

    def _put(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.stream.write(data)

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        words, starts, counts = pack(ids)
        self._put(words.astype("<u8").tobytes())
        self.starts.append(starts + np.uint64(self.words))
        self.counts.append(counts)
        self.docs.append(np.array(doc_ids, "<i8"))
        self.sizes.append(np.array(sizes, "<u8"))
        self.words += len(words)

    def close(self) -> tuple[int, int]:
        """Numbers of documents and ids."""
        for part in (self.starts, self.counts, self.docs, self.sizes):
            self._put(np.concatenate(part).astype("<i8" if part is self.docs else "<u8").tobytes())
        n_docs = sum(map(len, self.docs))
        self._put(np.array([self.words, sum(map(len, self.starts)), n_docs], "<u8").tobytes())
        self.stream.write(np.array([self.crc], "<u8").tobytes() + MAGIC)
        self.stream.close()
        return n_docs, int(sum(int(s.sum()) for s in self.sizes))


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, ids per document, all ids) of a file's bytes; checks its crc."""
    if data[-8:] != MAGIC:
        raise ValueError("not a token file")
    words, blocks, docs, crc = np.frombuffer(data, "<u8", 4, len(data) - 40).tolist()
    if zlib.crc32(data[:-16]) != crc:
        raise ValueError("damaged token file")
    v = np.frombuffer(data, "<u8", words + 2 * blocks + 2 * docs)
    a, b, c = words, words + blocks, words + 2 * blocks
    return v[c:c + docs].astype(np.int64), v[c + docs:].astype(np.int64), unpack(v[:words], v[a:b], v[b:c])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_STOP, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_UPPER = re.compile("[^a-z\u00df-\u00f6\u00f8-\u00ff]")


# The declarations under which words encode by themselves.
_NORMALISED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class WordTokenizer:
    """Ids of white-space separated words, each encoded once by the tokenizers library.

    That holds for files that declare it: a normaliser that only composes, lower-cases and
    makes white space blanks, and a pre-tokenizer that drops white space and keeps words,
    digits and other characters apart.  There, lower-case words go to the merges as they are
    (their bytes in the library's alphabet) and are handed to them directly, and stops
    behind a word are a word of their own.  With any other declaration whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.special = [t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values()]
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.alphabet = {c: byte_level.pre_tokenize_str(c)[0][0] for c in letters}
        self.mapped = str.maketrans(self.alphabet)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.by_word = spec["normalizer"] == _NORMALISED and spec["pre_tokenizer"] == _SPLIT and spec["post_processor"] is None and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        self.direct = self.by_word and model["type"] == "BPE" and not model["dropout"] and model["end_of_word_suffix"] == "</w>"

    def _merge(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tok.model.tokenize(word.translate(self.mapped) if not word.isascii() else word)]).tobytes()

    def _plain(self, word: bytes) -> str | None:
        """The word as text if it consists of lower-case ASCII letters and those of ``alphabet``."""
        if word.isalpha():
            return word.decode() if word.islower() else None
        if word.isascii():
            return None
        text = word.decode()
        return text if text.isalpha() and max(text) <= "\u00ff" and min(text) >= "a" and not _UPPER.search(text) else None

    def _learn(self, words: list[bytes]) -> None:
        cache, merge, rest = self.cache, self._merge, [] if self.direct else words
        for w in words if self.direct else ():
            plain = self._plain(w)
            if plain is None:
                rest.append(w)
            else:
                cache[w] = merge(plain)
        for a in range(0, len(rest), 500):
            some = rest[a:a + 500]
            joined = [w.decode() for w in some]
            e = self.tok.encode(" ".join(joined), add_special_tokens=False)
            begin = np.cumsum([0, *(len(j) + 1 for j in joined)])
            cut = np.searchsorted([o[0] for o in e.offsets], begin) if e.ids else np.zeros(len(begin), np.int64)
            ids = np.array(e.ids, "<u4")
            for w, x, y in zip(some, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                cache[w] = ids[x:y].tobytes()

    def encode(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in a row, each closed by ``end_id``; ids per document) of UTF-8 texts."""
        n_docs = len(off) - 1
        if not self.by_word:
            data = raw.tobytes()
            some = self.tok.encode_batch([data[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], add_special_tokens=False)
            ids = [np.array([*e.ids, end_id], "<u4") for e in some]
            return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
        low = _LOWER[raw]  # ASCII only; the strings of special tokens keep their case
        lowered = low.tobytes()
        if any(s in lowered for s in self.special):
            low = raw
        start, end, doc = C.words(low, off)
        size = end - start
        packed = low[~C.SEPARATOR[low]]  # all words in a row
        first = np.cumsum(size) - size
        if self.direct:  # stops behind a letter or digit begin a word of their own
            new = np.zeros(len(packed), bool)
            new[1:] = _STOP[packed[1:]] & _ALNUM[packed[:-1]]
            new[first] = True
            whole, first = first, np.flatnonzero(new)
            doc = doc[np.searchsorted(whole, first, "right") - 1]
        offsets = np.r_[first, len(packed)].astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        cache = self.cache
        if len(cache) > WORDS_KEPT:  # go on with the words of this chunk
            cache = self.cache = {w: cache[w] for w in distinct if w in cache}
        new = [w for w in distinct if w not in cache]
        self._learn(new)
        ids = list(map(self.cache.__getitem__, distinct))
        ids.append(np.array([end_id], "<u4").tobytes())
        flat = np.frombuffer(b"".join(ids), "<u4")
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        word = np.insert(coded.indices.to_numpy(), np.searchsorted(doc, np.arange(n_docs), "right"), len(distinct))
        doc = np.insert(doc, np.searchsorted(doc, np.arange(n_docs), "right"), np.arange(n_docs))
        n = length[word]
        before = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat((np.cumsum(length) - length)[word] - before, n)
        return flat[at], np.bincount(doc, n, n_docs).astype(np.int64)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _write(folder: str, tokenizer: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        out = None
        for batch in batches:
            for t in C.chunks(batch, limit=WRITE_BYTES):
                if out is None:
                    part, path, stream = part_files.writer(folder, ".s8b")
                    out = TokenFile(stream)
                ids, sizes = _tokenizer(tokenizer).encode(*C.text_buffer(t.column("text")), end_id)
                out.add(t.column("k").to_numpy(), sizes, ids)
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]}, schema)

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes documents in doc_id order; returns the manifest (part, path, n_docs, n_ids, start)."""
    parts = C.parts_for(docs.sparkSession, C.text_bytes(docs), FILE_BYTES)
    d = docs.select(C.id_key().alias("k"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("dk"))
    d = d.repartitionByRange(parts, "k", "dk").sortWithinPartitions("k", "dk").select("k", "text")
    manifest = d.mapInArrow(_write(part_files.qualified(docs.sparkSession, folder), tokenizer, end_id), "part int, path string, n_docs long, n_ids long")
    manifest = C.keep(manifest.repartition(1), "token-manifest")  # a row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                docs, sizes, ids = read_file(part_files.read(path))
                ids = ids.astype("<u4" if not len(ids) or ids.max() < 1 << 32 else "<u8")
                ends = np.cumsum(sizes)
                out = {"doc_id": pa.array(docs, mask=docs == C.NULL_ID), "start": start + ends - sizes, "n_tokens": sizes,
                       "ids_crc32": [zlib.crc32(ids[a:e]) for a, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), ids.astype(np.int64))
                yield pa.RecordBatch.from_pydict(out, schema)

    return run


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return part_files.spread(manifest, manifest.count()).mapInArrow(_read(with_ids), out)
