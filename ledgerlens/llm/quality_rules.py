"""Quality rules with host-level verdicts, in DataFrame functions only.

Document rules: base rules reject a document by itself; a milder rule
(``suspect``) only marks it.  Host rules: the share of a host's documents that
fail is shrunk towards the overall share by a beta prior fitted to all hosts
(method of moments), so a host with few documents is not judged by them alone.
Host verdicts join back: in a host whose shrunk failure rate is above
``host_limit``, suspect documents go as well; its clean documents stay.

Word windows are compared inside their document's row (arrays of 64-bit hashes,
sorted), so nothing but a digest row per document is ever shuffled; hosts are
aggregated map-side, so a host with a third of all rows costs no more.

Defined results: null and empty text have no words and fail; null hosts form a
host of their own; rows are independent, so ties and repeated rows need no rule
(each counts for its host); with fewer than two hosts, or no spread among them,
the prior has weight ``FLAT_WEIGHT``; extra columns are kept by ``passing`` and
ignored by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C

_WORD_GAP = r"[\x20\x09-\x0D]+"
_WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: In percent of the words: repeats that fail a document, and that make it suspect.
MAX_REPEATED = 50
SUSPECT_REPEATED = 30
#: In percent of the characters in words: symbols that make a document suspect.
SUSPECT_SYMBOLS = 10
#: Shrunk failure rate (percent) above which a host is bad.
HOST_LIMIT = 50
FLAT_WEIGHT = 2.0
_DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_rules(docs: DataFrame) -> DataFrame:
    """Adds the columns of ``_DIGEST``, ``base_failed`` and ``suspect``; in the row, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, _WORD_GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, _WHITE, "")) > 0)
    d = docs.withColumn("_words", words).withColumn("_lines", lines)
    at = lambda i: F.get(F.col("_words"), i)
    # (hash, place) of each window of three words, in order of the hash
    windows = F.when(F.size("_words") >= 3, F.array_sort(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_words") - 3, F.lit(0))), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("p")))))
    d = d.withColumn("_windows", windows)
    near = lambda i: F.get(F.col("_windows"), i)["h"]
    repeated = F.filter(F.col("_windows"), lambda x, i: F.coalesce(x["h"] == near(i - 1), F.lit(False)) | F.coalesce(x["h"] == near(i + 1), F.lit(False)))
    # ascending places; each adds the words that the one before does not cover
    d = d.withColumn("_places", F.array_sort(F.transform(repeated, lambda x: x["p"])))
    covered = F.aggregate(F.col("_places"), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                          lambda s, p: F.struct((s["n"] + F.least(p - s["last"], F.lit(3))).alias("n"), p.alias("last")), lambda s: s["n"])
    n_words = F.size("_words").cast("long")
    d = (d.withColumn("n_words", n_words)
         .withColumn("word_chars", F.length(F.translate(text, _WHITE, "")).cast("long"))
         .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
         .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
         .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    suspect = (100 * F.col("n_repeat_words") > SUSPECT_REPEATED * F.col("n_words")) | (100 * F.col("n_symbols") > SUSPECT_SYMBOLS * F.col("word_chars"))
    return d.drop("_words", "_lines", "_windows", "_places").withColumn("base_failed", failed).withColumn("suspect", suspect)


def host_verdicts(rows: DataFrame, host_limit: int = HOST_LIMIT) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), bad; one row per host of rows with host and base_failed."""
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    share = F.col("n_failed") / F.col("n_docs")
    # one row: mean m and variance v of the hosts' shares; beta(a, b) with a + b = m (1 - m) / v - 1
    fit = hosts.agg(F.avg(share).alias("m"), F.var_samp(share).alias("v"))
    spread = F.col("m") * (1 - F.col("m"))
    weight = F.when((F.col("v") > 0) & (spread > F.col("v")), spread / F.col("v") - 1).otherwise(F.lit(FLAT_WEIGHT))
    prior = fit.select((F.col("m") * weight).alias("a"), weight.alias("weight")).first()
    rate = (F.col("n_failed") + F.lit(prior["a"])) / (F.col("n_docs") + F.lit(prior["weight"]))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (100 * rate > host_limit).alias("bad"))


def _verdict(rows: DataFrame, host_limit: int) -> DataFrame:
    """Adds kept to rows with host, base_failed and suspect."""
    bad = host_verdicts(rows, host_limit).filter("bad").select(F.col("host").alias("_host"), F.lit(True).alias("_bad"))
    return (rows.join(bad, F.col("host").eqNullSafe(F.col("_host")), "left")
            .withColumn("kept", ~(F.col("base_failed") | (F.coalesce("_bad", F.lit(False)) & F.col("suspect")))).drop("_host", "_bad"))


def judge(docs: DataFrame, host: str = "source", host_limit: int = HOST_LIMIT) -> DataFrame:
    """Per document: doc_id, the rule counts, base_failed, suspect, host, kept."""
    rows = C.keep(with_rules(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(host).alias("host"))).drop("text"), "quality-rows")
    return _verdict(rows, host_limit)


def passing(docs: DataFrame, host: str = "source", host_limit: int = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns (rules of a text are computed once).

    Only suspect documents depend on their host, so only they are joined with the bad hosts;
    all others are kept or dropped where they stand.
    """
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"), F.col(host).alias("host"))
    rows = C.keep(with_rules(marked).select("_row", "host", "base_failed", "suspect"), "quality-passing")
    bad = host_verdicts(rows.select("host", "base_failed"), host_limit).filter("bad").select(F.col("host").alias("_host"))
    passed = rows.filter(~F.col("base_failed"))
    doubtful = passed.filter("suspect").join(bad, F.col("host").eqNullSafe(F.col("_host")), "left_anti")
    return passed.filter(~F.col("suspect")).unionByName(doubtful).select("_row.*")
