"""SentencePiece BPE encoding and decoding by vectorised merge rounds in numpy.

A text becomes a space followed by its characters (the dummy prefix of the
model).  No piece of such a model continues over a word start, so text is cut
into words that merge independently; each task encodes a word once and looks it
up afterwards.  Words not met before are encoded together: their symbols lie in
one flat array, each round looks up all neighbouring pairs, takes the best rank
of each word (segmented minimum), merges its occurrences leftmost first without
overlap, compacts the array, and sets aside words that have no pair left.
Characters outside the vocabulary fall back to byte pieces.

Merging all occurrences of the best pair at once equals merging them one by one
unless a piece can grow into a better ranked one; for such pieces (runs of
spaces, in the model used here) a round takes the leftmost occurrence only.

The model file must use identity normalisation, keep extra white space, and add
a dummy prefix; others are refused.  Decoding joins pieces and byte pieces,
drops control ids and the dummy prefix, and replaces malformed bytes by U+FFFD.

Defined results: null and empty text give the end id alone and decode to "";
rows are independent, so ties, repeated rows and repeated ids need no rule;
extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C

#: Words a task remembers; beyond it, it goes on with those of its latest chunk.
WORDS_KEPT = 400_000
#: Symbols from here on are characters (code point added), ids below are pieces.
_CHAR = 1 << 24
_NONE = np.int32(2**31 - 1)
_SPACE = "▁"


class PairTable:
    """Open-addressing lookup of symbol pairs, probed for whole arrays at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(8, (8 * max(len(pairs), 1)).bit_length())
        n = 1 << self.bits
        self.keys = np.zeros(n, np.uint64)
        self.rank = np.full(n, _NONE, np.int32)
        self.piece = np.zeros(n, np.int32)
        keys = self._key(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))
        for key, slot, (piece, rank) in zip(keys.tolist(), self._slot(keys).tolist(), pairs.values(), strict=True):
            while self.keys[slot]:
                slot = (slot + 1) & (n - 1)
            self.keys[slot], self.piece[slot], self.rank[slot] = key, piece, rank

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(26) | b.astype(np.uint64)) + np.uint64(1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair, or -1."""
        keys = self._key(a, b)
        slot = self._slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, slot, -1)
        todo = np.flatnonzero((have != keys) & (have != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            have = self.keys[slot[todo]]
            hit = have == keys[todo]
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (have != 0)]
        return out


class PieceModel:
    """Vocabulary of a SentencePiece BPE model, with the merge rounds."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(sp.serialized_model_proto())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("need a BPE model with byte fallback, identity normalisation and a dummy prefix")
        kinds = type(proto.pieces[0])
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.end_id = sp.eos_id()
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = {s: n for n, s in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        rank = {i: order[proto.pieces[i].score] for i in normal.values()}

        def symbol(s: str) -> int | None:
            return normal.get(s, _CHAR + ord(s) if len(s) == 1 else None)

        pairs, grows = {}, set()
        for s, i in normal.items():
            for cut in range(1, len(s)):
                a, b = symbol(s[:cut]), symbol(s[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (i, rank[i])
                    grows |= {x for x in (a, b) if x in rank and rank[i] <= rank[x]}
        self.pairs = PairTable(pairs)
        self.grows = np.zeros(len(proto.pieces), bool)
        self.grows[list(grows)] = True
        self.chars = _CHAR + np.arange(0x110000, dtype=np.int32)
        for s, i in normal.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        self.chars[0x20] = self.chars[ord(_SPACE)]
        #: Bytes of each id when decoded; control and unknown ids have none.
        self.surface = [p.piece.replace(_SPACE, " ").encode() if p.type == kinds.NORMAL else b"" for p in proto.pieces]
        for b, i in enumerate(self.byte_id):
            self.surface[i] = bytes([b])
        self.decimal = [b"%d" % i for i in range(len(proto.pieces))]
        inner = any(_SPACE in s.lstrip(_SPACE) for s in normal)
        newline = any("\n" in s and len(s) > 1 for s in normal)
        self.word = re.compile(rb"(?s).+" if inner else rb" *[^ ]+| +" if newline else rb" *[^ \n]+|\n| +")

    def words(self, text: bytes) -> list[bytes]:
        return self.word.findall(b" " + text.replace(_SPACE.encode(), b" ")) if text else []

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        lead = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        ends = lead[np.cumsum(sizes)]
        count = np.diff(ends, prepend=0)
        sym = self.chars[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), count)
        done_word, done_sym = [], []
        while len(sym):
            slot = self.pairs.find(sym[:-1], sym[1:])
            slot[word[:-1] != word[1:]] = -1
            rank = np.full(len(sym), _NONE, np.int32)
            has = slot >= 0
            rank[:-1][has] = self.pairs.rank[slot[has]]
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, head)
            size = np.diff(np.r_[head, len(sym)])
            each = np.repeat(best, size)
            over = each == _NONE
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
            pick = np.flatnonzero((rank == each) & ~over)
            if len(pick):
                new = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1] + 1])
                nth = np.arange(len(pick)) - np.repeat(new, np.diff(np.r_[new, len(pick)]))
                pick = pick[nth % 2 == 0]
                piece = self.pairs.piece[slot[pick]]
                if (odd := self.grows[piece]).any():  # leftmost only, in words that have such a piece
                    w = word[pick]
                    first = np.r_[True, w[1:] != w[:-1]]
                    stay = first | ~np.isin(w, w[odd])
                    pick, piece = pick[stay], piece[stay]
                sym[pick] = piece
                over[pick + 1] = True
            sym, word = sym[~over], word[~over]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        by = np.argsort(word, kind="stable")
        word, sym = word[by], sym[by]
        if (sym >= _CHAR).any():  # characters without a piece become their bytes
            part = [[s] if s < _CHAR else [self.byte_id[b] for b in chr(s - _CHAR).encode()] for s in sym.tolist()]
            word = np.repeat(word, [len(p) for p in part])
            sym = np.fromiter(chain.from_iterable(part), np.int32)
        return sym, np.bincount(word, minlength=len(words))

    def decode(self, ids) -> str:
        out = b"".join([self.surface[i] for i in ids])
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


class WordCache:
    """ids (as decimal text) and surface bytes of the words met so far."""

    def __init__(self, model: PieceModel):
        self.model, self.ids, self.surface = model, {}, {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.ids) > WORDS_KEPT:
            self.ids, self.surface = ({w: d[w] for w in words & d.keys()} for d in (self.ids, self.surface))
        new = list(words - self.ids.keys())
        if not new:
            return
        flat, count = self.model.merge(new)
        flat = flat.tolist()
        decimal = [self.model.decimal[i] for i in flat]
        surface = [self.model.surface[i] for i in flat]
        a = 0
        for w, n in zip(new, count.tolist(), strict=True):
            self.ids[w] = b" ".join(decimal[a:a + n])
            self.surface[w] = b"".join(surface[a:a + n])
            a += n


def _codec(path: str, with_ids: bool, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
                       + [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded", pa.string())] * with_text)

    def run(batches):
        model = load_model(path)
        cache = WordCache(model)
        tail = b"%d" % model.end_id
        for batch in batches:
            for t in C.chunks(batch):
                docs = [model.words(x) for x in C.texts(t.column("text"))]
                cache.learn(set(chain.from_iterable(docs)))
                out = {name: [] for name in schema.names}
                out["doc_id"] = t.column("doc_id").to_pylist()
                for words in docs:
                    ids = b" ".join(map(cache.ids.__getitem__, words))
                    ids = ids + b" " + tail if ids else tail
                    text = b"".join(map(cache.surface.__getitem__, words))[1:]
                    out["n_tokens"].append(ids.count(b" ") + 1)
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
                    if with_ids:
                        out["ids"].append(list(map(int, ids.split())))
                    if with_text:
                        out["decoded"].append(text.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_pydict(out, schema)

    return run


def encode_decode(docs: DataFrame, model_path: str, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens (end id included), ids_sha256, decoded_sha256, ids, decoded.

    No shuffle: each partition is encoded where it is read.
    """
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_codec(model_path, with_ids, with_text), out)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and decoded text of rows with doc_id and ids (null ids: "")."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches):
        model = load_model(model_path)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "decoded": [model.decode(x or []) for x in b.column("ids").to_pylist()]}, schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")
