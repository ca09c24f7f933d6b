"""Token counts against the tokenizers library."""

import json
import random

import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import queries
from ledgerlens.llm import token_counts as T

PATH = queries.tokenizer_file("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "it's 's ''s  's\n's we'll've'd'x'r 're'lla 'T I'm'm", "<|endoftext|>", " a <|endoftext|>  <|endoftext|>b ", "<|endoftext|",
       "\n\n x\t y  z　q  ", "日本語 text é́ ١٢٣ ½ Ⅷ", "a" * 5000, "-" * 777, "  \n", "x\x00\x1c\x1d\x85y​z", "  ﻿", "🙂🙂 ok", "'", "x'", "' s"]


def sample(rng, n):
    alphabet = list(" \n\t'sstreelvmd<|>aAb1 2é日 !?.,\U0001F600́")
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_equals_the_library():
    texts = ODD + sample(random.Random(1), 1500)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(points[k:k + 997]) for k in range(0, len(points), 997 * 9)]
    counter = T.Counter(T.load_model(PATH))
    want = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert counter.tokens([t.encode() for t in texts]).tolist() == want
    assert counter.tokens([t.encode() for t in texts[::-1]]).tolist() == want[::-1]  # from what is remembered


def test_remembered_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(T, "KEPT", 50)
    monkeypatch.setattr(T, "MERGE_BYTES", 64)
    texts = sample(random.Random(2), 300) + ["q" * 300]
    counter, library = T.Counter(T.load_model(PATH)), Tokenizer.from_file(PATH)
    for t in texts:
        assert counter.tokens([t.encode()]).tolist() == [len(library.encode(t, add_special_tokens=False).ids)]
    assert not any(len(w) > T.KEPT_BYTES for w in counter.known) and len(counter.known) < 200


def test_rows(spark):
    rows = [(1, "hello world"), (1, "hello world"), (None, "a b"), (2, None), (3, ""), (4, "é" * 3000 + " x")]
    df = spark.createDataFrame([(i, t, "n", 7) for i, t in rows], "doc_id long, text string, n_tokens string, n_bytes int")
    library = Tokenizer.from_file(PATH)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in T.token_counts(df, PATH).collect())
    assert got == sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert T.token_counts(df.limit(0), PATH).count() == 0


def small_file(folder, merges, **changes):
    """A byte-level file of single bytes and the given merges."""
    vocab = {c: i for i, c in enumerate(sorted(T._byte_symbols()))}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None,
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
            "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [list(m) for m in merges]}}
    spec["model"] |= changes
    path = str(folder / "own.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    return path


def test_symbols_that_pair_again_at_a_lower_rank(tmp_path):
    path = small_file(tmp_path, [("aa", "b"), ("a", "a"), ("aa", "aa"), ("b", "a"), ("aab", "a")])
    model, library = T.ByteModel(path), Tokenizer.from_file(path)
    assert model.again.any()
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    assert T.Counter(model).tokens([t.encode() for t in texts]).tolist() == [len(library.encode(t).ids) for t in texts]


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        T.ByteModel(small_file(tmp_path, [("a", "b")], ignore_merges=True))
    with pytest.raises(ValueError):
        T.ByteModel(queries.tokenizer_file("word_bpe_49k.json"))
