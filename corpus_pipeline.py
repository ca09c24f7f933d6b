"""Training-corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written
as Parquet under the shared checkpoint folder and reread as the next one's docs.
All but the last return the columns of documents:

1. quality: documents that the document and host rules reject go;
2. lines: later copies of runs of lines are cut from the texts, documents with
   nothing left go;
3. near: of each class of near-duplicates (five-word shingles, 80 percent) the
   document of smallest doc_id stays;
4. benchmark: documents with a benchmark region go;
5. tokens: SentencePiece encoding and decoding of what is left.

Nulls, empty texts, ties, repeated rows and clashing names have the results that
the operators' docstrings state; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontaminate, line_dedup, minhash_dedup, piece_codec, quality_rules
from ledgerlens.llm.common import keep, table
from ledgerlens.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=False, with_text=False)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]

#: Components, alignment and piece merges have no SQL form; the tests run brute-force versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
