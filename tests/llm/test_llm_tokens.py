"""SentencePiece codec and token files against the libraries, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerlens.llm import piece_codec, token_files
from ledgerlens.llm.queries import tokenizer_file

PIECES, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")
ALPHABET = [" ", "  ", "\n", "\t", "a", "the", "ing", " in", "é", "É", "日本", "\U0001F600", ".", "!?", '"', "'s", "　", "\xa0", "\r", "1", "23", "▁", "<s>", "<0x0A>", "\x00", "aaaa",
            "----", "ﬁ", "ß", "    ", "́", "Σ", "İ", "\x0b", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "Hello", "WORLD.", "can't", "가", "\x1c"]
CLASH = "doc_id long, text string, k string, dk long, ids string, start long, decoded string, part int"


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b", 2, "c", 3) for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts(300, 1))) + [(400, None), (401, ""), (401, ""), (402, "word " * 50000), (403, "x" * 50000), (None, "no id")]


def test_encode_decode(spark, rows):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = piece_codec.encode_decode(frame(spark, rows), PIECES)
    got = out.collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        ids = sp.encode(t or "") + [sp.eos_id()]
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), ids, sp.decode(ids))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) for r in got} == want
    again = {r.doc_id: r.decoded for r in piece_codec.decode(out.select("doc_id", "ids"), PIECES).collect()}
    assert again == {i: w[4] for i, w in want.items()}
    assert piece_codec.encode_decode(frame(spark, []), PIECES).count() == 0


def test_decode_of_any_ids():
    import sentencepiece
    sp, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.load_model(PIECES)
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice([1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(8))]
        if all(i >= 259 or i < 3 for i in ids):
            assert model.decode(ids) == sp.decode(ids), ids


def test_merge_learns_words_beyond_its_cache(monkeypatch):
    import sentencepiece
    monkeypatch.setattr(piece_codec, "WORDS_KEPT", 5)
    sp, cache = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.WordCache(piece_codec.load_model(PIECES))
    for t in texts(200, 8):
        words = cache.model.words(t.encode())
        cache.learn(set(words))
        assert b" ".join(cache.ids[w] for w in words).decode() == " ".join(map(str, sp.encode(t)))


@pytest.mark.parametrize("seed", range(12))
def test_pack_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 12000))
    ids = rng.integers(0, 1 << int(rng.integers(1, 63)), n, dtype=np.uint64)
    if n and seed % 2:
        ids[rng.integers(0, n, 7)] = rng.integers(1 << 60, 1 << 64, 7, dtype=np.uint64)  # escapes, with any top bits
        ids[: n // 3] = 1
    words, starts, counts = token_files.pack(ids)
    assert np.array_equal(token_files.unpack(words, starts, counts), ids)
    for b in range(len(starts)):  # every block by itself
        end = int(starts[b + 1]) if b + 1 < len(starts) else len(words)
        part = token_files.unpack(words[int(starts[b]):end], np.zeros(1, np.uint64), counts[b:b + 1])
        assert np.array_equal(part, ids[b * token_files.BLOCK:(b + 1) * token_files.BLOCK])


def test_pack_takes_all_that_fit():
    words, _, _ = token_files.pack(np.array([1] * 60 + [300] * 6 + [5], np.uint64))
    assert [int(w >> np.uint64(60)) for w in words] == [1, 9, 14]


def test_token_files(spark, rows, tmp_path, monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(token_files, "FILE_BYTES", 100_000)  # several files
    tok = Tokenizer.from_file(WORDS)
    manifest = token_files.write_token_files(frame(spark, rows), str(tmp_path / "ids"), WORDS, end_id=2)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and manifest.count() > 1
    at, by_id = 0, {i: t for i, t in rows}
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    for r in got:
        ids = [*tok.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = token_files.write_token_files(frame(spark, []), str(tmp_path / "none"), WORDS, end_id=2)
    assert token_files.read_token_files(empty).count() == 0


def test_damaged_file_is_refused(tmp_path):
    path = tmp_path / "x"
    with open(path, "wb") as f:
        out = token_files.TokenFile(f)
        out.add(np.array([7]), np.array([3]), np.array([1, 2, 70000]))
        assert out.close() == (1, 3)
    data = path.read_bytes()
    docs, sizes, ids = token_files.read_file(data)
    assert (docs.tolist(), sizes.tolist(), ids.tolist()) == ([7], [3], [1, 2, 70000])
    with pytest.raises(ValueError):
        token_files.read_file(bytes([data[0] ^ 1]) + data[1:])
