"""The pipeline and the registered queries, against brute-force versions on a small fixture."""

import importlib.util
import os
import random

import brute
import pytest

from ledgerlens.llm import decontaminate
from ledgerlens.llm.queries import ORACLES, QUERIES, tokenizer_file

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def load(name):
    spec = importlib.util.spec_from_file_location(name.strip("_"), os.path.join(ROOT, f"{name}.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice("abcdefg") + str(rng.randrange(500)) for _ in range(n))
    items = [(n, text(30)) for n in range(4)]
    shared = text(70)
    docs = []
    for i in range(60):
        parts = [text(rng.choice([20, 55])) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.3:
            parts.insert(rng.randrange(len(parts) + 1), shared)
        if rng.random() < 0.2:
            parts[0] += " " + items[rng.randrange(4)][1]
        docs.append((i, "\n".join(parts), rng.choice("xy")))
    near = docs[7][1].replace("\n", " ").split()  # on one line: a near copy that line dedup leaves
    docs += [(100 + k, " ".join(near[:k] + ["new"] + near[k:]), "x") for k in (3, 9)]
    docs += [(110, docs[4][1], "x"), (111, docs[4][1], "y"), (112, None, None), (113, "", "x"), (114, text(10), "z"), (115, text(60), None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_pipeline_equals_brute_force(spark, corpus):
    import sentencepiece
    folder, docs, items = corpus
    verdict = brute.quality(docs)
    rows = [(i, t) for i, t, _ in docs if verdict[i][7]]
    cut = brute.line_dedup(rows, 50)
    rows = [(i, cut[i][2]) for i, _ in rows if cut[i][1] < cut[i][0]]
    found = brute.classes(rows, 5, 80)
    rows = [(i, t) for i, t in rows if found[i][1] == i]
    index = decontaminate.Benchmark(items)
    rows = [(i, t) for i, t in rows if not any(brute.edits_inside(index.bytes[s, :index.size[s]].tobytes(), brute.normal(t)) <= index.edits[s] for s in range(len(index.size)))]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = {}
    for i, t in rows:
        ids = [*sp.encode(t), sp.eos_id()]
        want[i] = (len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha(sp.decode(ids).encode()))
    pipeline = load("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near", "benchmark", "tokens"]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, folder).collect()}
    assert got == want and 20 < len(got) < len(docs) - 10


def test_stages_keep_the_columns(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in load("corpus_pipeline").STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
    assert docs.filter("n_chars <> length(text)").count() == 0


def test_pipeline_on_empty_tables(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert load("corpus_pipeline").run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    entry = load("__spark_entry__")
    names = set(entry.queries())
    assert {*QUERIES, "pipeline"} <= names and set(ORACLES) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
