"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging in numpy.

1. Split: a text is cut at the file's special strings (a token each), the rest
   into pre-tokens by the fixed byte-level pattern, from the class (letter,
   number, white space, other) of each code point; array comparisons find all
   starts of a chunk of texts at once.  The classes are the library's own: its
   pre-tokenizer is asked once for each code point that a task meets.
2. Merge: the pre-tokens that the task meets for the first time lie in one flat
   symbol array, a symbol per byte at first.  Each round looks up all
   neighbouring pairs, takes the lowest rank of each sequence, merges all its
   occurrences (leftmost first, without overlap) and compacts the array.
   Sequences in which no pair is left are set aside.
3. Count: the symbols left of each pre-token, summed over each document.

Merging all occurrences at once equals merging them one by one unless a symbol
made by a merge can pair again at the same or a lower rank; merges that make
such symbols take the leftmost occurrence only.

Refused: files with a normaliser, a post-processor that adds tokens, another
pre-tokenizer than byte-level with its pattern and no added space, dropout,
``ignore_merges``, sub-word affixes, or added tokens with options.  Truncation
and padding of a file are ignored.

Defined results: null and empty text have 0 bytes and 0 tokens; rows are
independent, so ties, repeated rows, null and repeated ids need no rule; extra
columns are ignored whatever their names.  A task holds a chunk of texts (or a
single longer one) and a bounded number of short pre-tokens with their counts;
a pre-token of any length is merged whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C
from ledgerlens.llm.piece_codec import PairTable

#: Pre-tokens a task remembers, and the bytes of the longest remembered one.
KEPT, KEPT_BYTES = 400_000, 64
#: Bytes of pre-tokens merged together.
MERGE_BYTES = 1 << 20
_NONE = np.int32(2**31 - 1)
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
#: Fixed values of the byte-level pattern: endings that stay with an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_symbols() -> dict[str, int]:
    """Byte behind each character of the byte-level alphabet: printable bytes stand for themselves."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(other)}


class ByteModel:
    """Pre-token classes, merges and special strings of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        added = spec.get("added_tokens") or []
        if (model["type"] != "BPE" or spec["normalizer"] or spec["post_processor"] and spec["post_processor"].get("type") != "ByteLevel" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")) or any(t[x] for t in added for x in ("single_word", "lstrip", "rstrip")) or any(not t["content"] for t in added)):
            raise ValueError("need a plain byte-level BPE file: no normaliser, no added space, no sub-word affixes")
        vocab, byte = model["vocab"], _byte_symbols()
        if not set(byte) <= set(vocab):
            raise ValueError("the vocabulary lacks single bytes")
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.first = np.zeros(256, np.int32)
        for c, b in byte.items():
            self.first[b] = vocab[c]
        pairs, made = {}, {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[a], vocab[b]] = (vocab[a + b], rank)
            made.setdefault(vocab[a + b], []).append(rank)
        again = {x for p, (_, rank) in pairs.items() for x in p if any(rank <= r for r in made.get(x, ()))}
        self.pairs = PairTable(pairs)
        self.again = np.zeros(max(vocab.values()) + 1, bool)
        self.again[list(again)] = True
        self.kind = np.full(0x110000, -1, np.int8)

    def _classify(self, points: np.ndarray) -> None:
        """Asks the pre-tokenizer: a letter joins a letter, a number a number, another character another."""
        for a in range(0, len(points), 1 << 14):
            some = points[a:a + (1 << 14)]
            kind = np.full(len(some), _SPACE, np.int8)
            for mate, between, name in (("a", "1", _LETTER), ("1", "a", _NUMBER), ("!", "a", _OTHER)):  # between ends what the mate began
                text = between + "".join(chr(p) + mate + between for p in some.tolist())
                starts = np.array([s for _, (s, _) in self.pre.pre_tokenize_str(text)], np.int64)
                kind[~np.isin(1 + 3 * np.arange(len(some)) + 1, starts)] = name
            kind[some == 0x20] = _SPACE  # joins all of them
            self.kind[some] = kind

    def starts(self, points: np.ndarray, off: np.ndarray) -> np.ndarray:
        """First code points of the pre-tokens of texts that lie in a row, cut at ``off`` (from 0 to the end)."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kind[points]
        if (kind < 0).any():
            self._classify(np.unique(points[kind < 0]))
            kind = self.kind[points]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        head = edge[:-1].copy()
        head[1:] |= kind[1:] != kind[:-1]
        # White space before a word: its last character stands alone, or goes with the word if it is a blank.
        run = np.flatnonzero(head)
        last = np.r_[run[1:], n] - 1
        before = last[(kind[last] == _SPACE) & ~edge[last + 1]]
        head[before] = True
        blank = before[points[before] == 0x20]
        head[blank + 1] = False
        # 's and the like: a lone apostrophe with no blank before it, and the letters after it.
        at = np.flatnonzero(head & (points == 0x27))
        at = at[(at + 1 < n)]
        at = at[~edge[at + 1] & (kind[at + 1] == _LETTER)]
        todo = np.ones(len(at), bool)
        for e in _ENDINGS:
            hit = todo & (at + len(e) < n)
            for k, c in enumerate(e, 1):
                here = np.minimum(at + k, n - 1)
                hit &= (points[here] == ord(c)) & ~edge[here]
            head[at[hit] + 1] = False
            after = at[hit] + 1 + len(e)
            head[after[after < n]] = True
            todo &= ~hit
        return np.flatnonzero(head)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each sequence of bytes after all merges."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.first[raw]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        out = np.zeros(len(words), np.int64)
        while len(sym):
            slot = self.pairs.find(sym[:-1], sym[1:])
            slot[word[:-1] != word[1:]] = -1
            rank = np.full(len(sym), _NONE, np.int32)
            has = slot >= 0
            rank[:-1][has] = self.pairs.rank[slot[has]]
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[head, len(sym)])
            lowest = np.minimum.reduceat(rank, head)
            done = lowest == _NONE
            out[word[head[done]]] = size[done]
            lowest = np.repeat(lowest, size)
            gone = lowest == _NONE
            pick = np.flatnonzero((rank == lowest) & ~gone)
            if len(pick):
                new = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1] + 1])
                nth = np.arange(len(pick)) - np.repeat(new, np.diff(np.r_[new, len(pick)]))
                pick = pick[nth % 2 == 0]  # of overlapping ones the first, third, ...
                made = self.pairs.piece[slot[pick]]
                if (odd := self.again[made]).any():
                    w = word[pick]
                    stay = np.r_[True, w[1:] != w[:-1]] | ~np.isin(w, w[odd])
                    pick, made = pick[stay], made[stay]
                sym[pick] = made
                gone[pick + 1] = True
            sym, word = sym[~gone], word[~gone]
        return out


@lru_cache(maxsize=2)
def load_model(path: str) -> ByteModel:
    return ByteModel(path)


class Counter:
    """Tokens of texts, with the counts of the short pre-tokens met so far."""

    def __init__(self, model: ByteModel):
        self.model, self.known = model, {}

    def _learn(self, words: list[bytes]) -> dict[bytes, int]:
        """Counts of all ``words``; the short ones among the new are remembered."""
        if len(self.known) > KEPT:
            self.known = {}
        met = set(words)
        new = sorted(met - self.known.keys(), key=len)
        counts = {}
        size = np.cumsum([len(w) for w in new])
        part = size // MERGE_BYTES
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if new else []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            counts |= zip(new[a:b], self.model.count(new[a:b]).tolist(), strict=True)
        self.known |= {w: n for w, n in counts.items() if len(w) <= KEPT_BYTES}
        return self.known if not new or len(new[-1]) <= KEPT_BYTES else self.known | counts

    def tokens(self, texts: list[bytes]) -> np.ndarray:
        out, pieces, owner = np.zeros(len(texts), np.int64), [], []
        for i, t in enumerate(texts):
            if self.model.special is None:
                some = [t]
            else:
                some = self.model.special.split(t.decode())  # special strings count once each
                out[i] += len(some) - 1
                some = [t] if len(some) == 1 else [x.encode() for x in some]
            pieces += [x for x in some if x]
            owner += [i] * sum(1 for x in some if x)
        data = b"".join(pieces)
        if not data:
            return out
        raw = np.frombuffer(data, np.uint8)
        lead = (raw & 0xC0) != 0x80
        place = np.flatnonzero(lead)  # byte of each code point
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in pieces])
        off = np.r_[0, np.searchsorted(place, ends)]
        start = self.model.starts(points, off)
        at = place[start].tolist()
        words = [data[a:b] for a, b in zip(at, [*at[1:], len(data)], strict=True)]
        known = self._learn(words)
        each = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        first = np.searchsorted(start, off[:-1])
        np.add.at(out, np.array(owner), np.add.reduceat(each, first))
        return out


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens (no begin, end or other added tokens).

    No shuffle: each partition is counted where it is read.  ``path`` is a
    byte-level BPE file of the tokenizers library.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        counter = Counter(load_model(path))
        for batch in batches:
            for t in C.chunks(batch):
                texts = C.texts(t.column("text"))
                yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array([len(x) for x in texts], pa.int64()), pa.array(counter.tokens(texts))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
