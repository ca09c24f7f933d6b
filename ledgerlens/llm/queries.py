"""Registered queries of this subpackage: ``QUERIES`` and, where SQL can express them, ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import keep, shared_folder, table
from ledgerlens.llm.decontaminate import decontaminate
from ledgerlens.llm.line_dedup import line_dedup
from ledgerlens.llm.minhash_dedup import near_duplicates
from ledgerlens.llm.periodic_runs import periodic_runs
from ledgerlens.llm.piece_codec import encode_decode
from ledgerlens.llm.quality_rules import judge
from ledgerlens.llm.secret_scan import scan
from ledgerlens.llm.sharding import shard
from ledgerlens.llm.spelling import tokens, variant_groups, word_counts
from ledgerlens.llm.substring_dedup import substring_dedup
from ledgerlens.llm.token_counts import token_counts
from ledgerlens.llm.token_files import read_token_files, write_token_files
from ledgerlens.llm.warc import REVISIT_BYTES, assemble, read_warc, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words over all documents; words of later repeats go."""
    return substring_dedup(table(spark, sf_dir, "documents"), size=20, keep_text=False).drop("intervals")


#: Words of a text column, as all contracts define them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: CTE ``crc``: the byte table of crc32, from its polynomial; and crc32 of a list of bytes.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS tab)"
_CRC = "xor(list_reduce(list_concat([4294967295], {bytes}), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295)"

ORACLES["op1_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS seq
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@_query
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by 3-word shingles at 85 percent; tested against brute force."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=85)


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; the operators take any path."""
    import public_tokenizers
    return public_tokenizers.path(name)


@_query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; no SQL form (tested against the library)."""
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_ids=False, with_text=False)


@_query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base patterns and lexed name-literal pairs of all documents; no SQL form for the lexing."""
    return scan(table(spark, sf_dir, "documents"), with_text=False).drop("found")


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules of all documents and the verdicts of their hosts (source)."""
    return judge(table(spark, sf_dir, "documents")).drop("suspect", "host")


ORACLES["op5_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM again) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^ 	-
]') GROUP BY doc_id),
r AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ 	-
]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * word_chars AS suspect FROM r),
h AS (SELECT source, count(*) AS n, CAST(sum(CAST(base_failed AS INT)) AS DOUBLE) AS f FROM b GROUP BY source),
m AS (SELECT avg(f / n) AS m, var_samp(f / n) AS v FROM h),
p AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 2.0 END AS s FROM m),
bad AS (SELECT source FROM h, p WHERE 100 * (f + m * s) / (n + s) > 50)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (suspect AND EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM b.source))) AS kept
FROM b
"""


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as Simple-8b files and read them back; no SQL form."""
    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, shared_folder(spark, "token-files"), tokenizer_file("word_bpe_49k.json"), end_id=2), with_ids=False)


@_query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of near equal bytes; no SQL form (crc32 and the capacity search)."""
    return shard(table(spark, sf_dir, "documents"), 16)


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC, read the records back and assemble the captures."""
    manifest = write_warc(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    captures = assemble(read_warc(manifest, with_payload=False)).select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"))
    captures = keep(captures, "warc-captures")
    responses = (captures.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= REVISIT_BYTES))
                 .groupBy("payload_digest").agg(F.max("page_id").alias("response_id")))
    revisits = captures.filter("record_type = 'revisit'").join(responses, "payload_digest", "left").withColumnRenamed("response_id", "refers_to")
    rest = captures.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return rest.unionByName(revisits)


ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
last AS (SELECT h, max(page_id) AS m FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < m THEN m END AS refers_to
FROM p LEFT JOIN last ON p.h = last.h
"""


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of maximal equal runs of lines with 50 words or more, over all documents.

    The SQL takes every run of 50 words or more that occurs earlier; together they are the maximal ones.
    """
    return line_dedup(table(spark, sf_dir, "documents"), keep_text=False)


ORACLES["op9_line_dedup"] = r"""
WITH raw AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i
             FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
line AS (SELECT doc_id, i, regexp_replace(l, '^[ 	-
]+|[ 	-
]+$', '', 'g') AS t, len(regexp_extract_all(l, '[^ 	-
]+')) AS w,
                row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
         FROM raw WHERE regexp_matches(l, '[^ 	-
]')),
d AS (SELECT doc_id, list(t ORDER BY p) AS t, list(w ORDER BY p) AS w FROM line GROUP BY doc_id),
s AS (SELECT doc_id, t, w, unnest(range(1, len(t) + 1)) AS a FROM d),
e AS (SELECT doc_id, t, a, w, unnest(range(a, len(t) + 1)) AS b FROM s),
run AS (SELECT doc_id, a, b, md5(array_to_string(t[a:b], chr(10))) AS run FROM e WHERE list_sum(w[a:b]) >= 50),
later AS (SELECT doc_id, a, b FROM (SELECT doc_id, a, b, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS r FROM run) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS p FROM later),
gone_line AS (SELECT doc_id, i FROM line JOIN gone USING (doc_id, p)),
kept AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS t FROM raw ANTI JOIN gone_line USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM line GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark regions within the edit budget in all documents; no SQL form for the alignment."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("regions")


def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, where a tenth of the documents repeats a stretch of words up to its end.

    With h the crc32 of the decimal doc_id: if 10 divides h, words from a on are those of one
    period p from a on, over and over.  Other texts, and those without an id, stay.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("_g"))
    w = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    d = d.withColumn("_w", F.when(F.col("_g").isNotNull(), w)).withColumn("_n", F.size("_w"))
    d = d.withColumn("_a", F.expr("_g % _n")).withColumn("_p", F.expr("1 + floor((_n - _a) / (3 + _g % 8))"))
    planted = F.expr("array_join(transform(sequence(0L, _n - 1L), i -> if(i < _a, _w[int(i)], _w[int(_a + (i - _a) % _p)])), ' ')")
    return d.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 6 words and 4 periods in all documents, a tenth of them with planted repeats."""
    return periodic_runs(planted_repeats(table(spark, sf_dir, "documents")), least=6, times=4, keep_text=False).drop("n_words")


ORACLES["op11_periodic_runs"] = rf"""
WITH {_CRC_TABLE},
raw AS (SELECT doc_id, {_WORDS} AS w, {_CRC.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} AS h FROM documents, crc),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM raw),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, g % 8 AS e FROM g),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + e)) END]) END AS w FROM a),
gram AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS t FROM (SELECT doc_id, n, w, unnest(range(n - 4)) AS i FROM d WHERE n >= 6)),
pair AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM gram a JOIN gram b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
island AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair) GROUP BY doc_id, q, k),
run AS (SELECT doc_id, s, l, min(q) AS q FROM island WHERE l >= 4 * q GROUP BY doc_id, s, l),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT doc_id, count(*) AS n, string_agg(concat_ws(',', s, l, q) || chr(10), '' ORDER BY s, q) AS t, first(s ORDER BY l DESC, s, q) AS s, first(l ORDER BY l DESC, s, q) AS l, first(q ORDER BY l DESC, s, q) AS q FROM run GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(best.n, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(best.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@_query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document in the byte-level vocabulary; no SQL form (tested against the library)."""
    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def planted_typos(found: DataFrame) -> DataFrame:
    """Words of (doc_id, word); a code point is gone where 199 divides the crc32 of ``doc_id:word``.

    A null doc_id stands as the empty string there.
    """
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    d = found.select("word", h.alias("_h")).withColumn("_p", F.expr("int(_h % length(word))"))
    cut = F.expr("concat(substring(word, 1, _p), substring(word, _p + 2))")
    return d.select(F.when(F.col("_h") % 199 == 0, cut).otherwise(F.col("word")).alias("word"))


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all frequent words of all documents, with planted deletions."""
    return variant_groups(word_counts(planted_typos(tokens(table(spark, sf_dir, "documents")))))


ORACLES["op13_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
tok AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
hashed AS (SELECT w, {_CRC.format(bytes="flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))")} AS h FROM tok, crc),
planted AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM hashed),
word AS (SELECT word, count(*) AS n FROM planted WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
cut AS (SELECT word, p, substr(word, 1, CAST(p AS INT)) AS a, substr(word, CAST(p AS INT) + 2) AS b FROM (SELECT word, unnest(range(length(word))) AS p FROM word)),
pair AS (SELECT x.word AS u, y.word AS v FROM cut x JOIN cut y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND x.word <> y.word
         UNION SELECT word, a || b FROM cut WHERE a || b IN (SELECT word FROM word)
         UNION SELECT a || b, word FROM cut WHERE a || b IN (SELECT word FROM word)),
near AS (SELECT u, count(*) AS n_near, first(v ORDER BY w.n DESC, v) AS v, max(w.n) AS m FROM pair JOIN word w ON v = w.word GROUP BY u),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN v END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM word LEFT JOIN near ON word = u),
path AS (SELECT word, word AS place FROM f UNION ALL SELECT path.word, f.form FROM path JOIN f ON path.place = f.word WHERE f.form IS NOT NULL),
root AS (SELECT path.word, place AS root FROM path JOIN f ON place = f.word WHERE f.form IS NULL)
SELECT word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN root USING (word)
"""


def load():
    return QUERIES, ORACLES
