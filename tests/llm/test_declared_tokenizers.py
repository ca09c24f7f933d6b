"""Token files: how words are encoded follows the tokenizer's declaration; folders are named by their whole URI."""

import json

from tokenizers import Tokenizer

from ledgerlens.llm import part_files, queries, token_files

PATH = queries.tokenizer_file("word_bpe_49k.json")


def test_other_declarations_encode_whole_texts(spark, tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert token_files.WordTokenizer(PATH).direct
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "\\S+\\s\\S+|\\S+"  # two words at a time: the first words alone would pass a trial
    spec["pre_tokenizer"]["pretokenizers"][0]["invert"] = True
    other = str(tmp_path / "other.json")
    with open(other, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    tok = token_files.WordTokenizer(other)
    assert not tok.by_word and not tok.direct
    rows = [(1, "one two three"), (2, None), (3, "stop. é x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_file(other)
    got = token_files.read_token_files(token_files.write_token_files(docs, f"{tmp_path}/files", other, end_id=2)).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}


def test_a_folder_without_scheme_lies_where_spark_writes(spark, tmp_path):
    folder = part_files.qualified(spark, f"{tmp_path}/x")
    assert folder.startswith("file:/") and part_files.qualified(spark, folder) == folder
    conf, key = spark._jsc.hadoopConfiguration(), "fs.defaultFS"
    before = conf.get(key)
    conf.set("fs.viewfs.mounttable.shared.link./at", f"file://{tmp_path}")
    conf.set(key, "viewfs://shared/")
    try:
        assert part_files.qualified(spark, "/at/x") == "viewfs://shared/at/x"
    finally:
        conf.set(key, before)
