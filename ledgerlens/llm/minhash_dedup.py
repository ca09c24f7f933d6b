"""MinHash near-dedup with sequential Bayesian verification.

Documents are linked if the Jaccard similarity of their sets of word shingles
reaches a threshold; a class is a connected component, its representative the
smallest doc_id.

1. Sets: numpy hashes of all shingles per document, the distinct ones counted,
   summed up to a 128-bit key of the set, and min-hashed.  Equal sets are linked
   at once and one of them, the smallest, goes on.
2. Bands: as many bands of ``ROWS`` min-hashes as leave a pair at the threshold
   without a shared band with probability ``MISS`` at most.
3. Stars: each bucket has a centre, the member that shares most buckets with
   others (the unedited copy of a group, mostly); members pair with centres, so
   a bucket costs a row per member whatever its size.  A centre meets its members
   in blocks: its signature, or text, travels once a block.
4. Verification: signatures are compared batch by batch; a pair is dropped as
   soon as the posterior probability (uniform prior) that its similarity reaches
   the threshold falls below ``MISS``.  Survivors are verified on their full sets.
5. Rest: buckets whose members are in different components by now meet again:
   members outside the bucket's largest component against all others, in hashed
   blocks of about ``BLOCK`` by ``BLOCK`` rows (or ``BLOCK_BYTES`` of text a side)
   with their signatures and texts.
   A task prunes and verifies a block's pairs as before and returns only links
   that join components, so neither pairs nor links multiply.  No link between
   classes is lost to the choice of centres.  Buckets that stars have joined are
   done, which keeps this part small.

In ``near_duplicates`` each row of a repeated doc_id belongs to that one document:
it is linked to whatever any of its rows is linked to.  ``representatives`` takes
rows that share a doc_id but differ in text as different documents, ordered by
their text's hash, so that some row of every class stays.

Defined results: null and empty texts, and texts without words, have no shingle
and no link; texts with fewer words than a shingle have one, the whole sequence;
null doc_ids are one document that sorts first; extra columns are kept by
``representatives`` (as one struct, so no name clashes), else ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C
from ledgerlens.llm.components import components

SHINGLE, THRESHOLD = 5, 80
#: Rows of a band; chance to miss a pair at the threshold, for the bands and for the pruning.
ROWS = 4
MISS = 1e-8
#: Min-hashes compared at once, and members of a block.
BATCH = 20
BLOCK = 1000
#: Bytes of text on a side of a block, about (a single longer document has a block alone).
BLOCK_BYTES = 16 << 20
_SLICE = 1 << 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


def band_count(threshold: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (threshold / 100) ** ROWS))


@lru_cache(maxsize=4)
def least_matches(threshold: int, hashes: int) -> tuple[int, ...]:
    """For each number of compared min-hashes (0, 1, ...) the fewest matches a pair may have to go on.

    With a uniform prior and m matches of n, P(similarity >= t) is the chance of
    at most m successes in n + 1 draws of probability t.
    """
    t = threshold / 100
    out = []
    for n in range(hashes + 1):
        total, m = 0.0, -1
        while total < MISS:
            m += 1
            total += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def shingles(raw: np.ndarray, off: np.ndarray, size: int, hasher: C.SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, by document and hash."""
    start, end, doc = C.words(raw, off)
    h = hasher(_FOLD[raw], start, end)
    g = C.rolling(h, size, 0x9E3779B97F4A7C15)
    full = doc[:len(g)] == doc[size - 1:] if len(g) else np.zeros(0, bool)
    docs, hashes = [doc[:len(g)][full]], [g[full]]
    count = np.bincount(doc, minlength=len(off) - 1)
    first = np.searchsorted(doc, np.arange(len(off) - 1))
    for n in range(1, size):  # short texts: the whole sequence
        some = np.flatnonzero(count == n)
        if len(some):
            docs.append(some)
            hashes.append(C.rolling(h, n, 0xC2B2AE3D27D4EB4F)[first[some]] ^ np.uint64(n))
    d, g = np.concatenate(docs), np.concatenate(hashes)
    by = np.lexsort((g, d))
    d, g = d[by], g[by]
    new = np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])] if len(d) else np.zeros(0, bool)
    return d[new], g[new]


class MinHash:
    def __init__(self, hashes: int):
        rng = np.random.default_rng(31)
        self.flip = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
        self.times = rng.integers(0, 1 << 31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def __call__(self, doc: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that have shingles, their signatures) of sorted (document, hash)."""
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        out = np.empty((len(head), len(self.flip)), np.uint32)
        x = (g >> np.uint64(32)).astype(np.uint32)
        part = head // _SLICE  # slices of whole documents stay in the cache
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            a, b = head[rows[0]], head[rows[-1] + 1] if rows[-1] + 1 < len(head) else len(x)
            some, at = x[a:b], head[rows] - a
            for i in range(len(self.flip)):
                out[rows, i] = np.minimum.reduceat((some ^ self.flip[i]) * self.times[i], at)
        return doc[head], out


def _sets(size: int, hashes: int):
    names = ("k", "dk", "n_shingles", "s1", "s2", "sig", "bands")

    def run(batches):
        hasher, minhash = C.SpanHash(30), MinHash(hashes)
        seed = C.mix(np.arange(hashes // ROWS, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            for t in C.chunks(batch):
                n = t.num_rows
                doc, g = shingles(*C.text_buffer(t.column("text")), size, hasher)
                some, sig = minhash(doc, g)
                head = np.searchsorted(doc, some)
                s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(some):
                    s1[some] = np.add.reduceat(C.mix(g), head)
                    s2[some] = np.add.reduceat(C.mix(g ^ np.uint64(0xA5A5A5A5DEADBEEF)), head)
                key = np.zeros((len(some), hashes // ROWS), np.uint64)
                for r in range(ROWS):
                    key = C.mix(key ^ sig[:, r::ROWS].astype(np.uint64)) + seed
                sigs, bands = [None] * n, [None] * n
                for i, s, b in zip(some.tolist(), sig, key.view(np.int64), strict=True):
                    sigs[i], bands[i] = s.tobytes(), b
                yield pa.RecordBatch.from_arrays([
                    t.column("k").combine_chunks(), t.column("dk").combine_chunks(), pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                    pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names)

    return run


def plausible(x: np.ndarray, y: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which pairs of signature rows keep a chance, batch by batch."""
    live = np.arange(len(x))
    match = np.zeros(len(x), np.int64)
    for a in range(0, x.shape[1] if len(x) else 0, BATCH):
        b = min(a + BATCH, x.shape[1])
        match[live] += (x[live, a:b] == y[live, a:b]).sum(axis=1)
        live = live[match[live] >= least[b]]
    return live


def _groups(batches, names: list[str]):
    """Tables of the rows that are equal in ``names``, of batches sorted by them."""
    held, at = [], None
    for b in batches:
        t = pa.Table.from_batches([b])
        where = [t.column(c).to_numpy() for c in names]
        new = np.flatnonzero(np.r_[True, np.any([w[1:] != w[:-1] for w in where], axis=0)]) if b.num_rows else []
        for x, y in zip(new, [*new[1:], b.num_rows], strict=True):
            here = tuple(int(w[x]) for w in where)
            if here != at and held:
                yield pa.concat_tables(held)
                held = []
            at = here
            held.append(t.slice(x, y - x))
    if held:
        yield pa.concat_tables(held)


_PAIR = pa.schema([("centre", pa.int64()), ("id", pa.int64())])


def _prune(threshold: int, hashes: int):
    """Members of a block that keep a chance with their centre, by the signatures."""
    def run(batches):
        least = least_matches(threshold, hashes)
        for t in _groups(batches, ["centre", "blk"]):
            is_centre = t.column("is_centre").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(t.column("payload").to_pylist()), np.uint32).reshape(-1, hashes)
            members = np.flatnonzero(~is_centre)
            live = np.zeros(len(members), bool)
            for c in np.flatnonzero(is_centre).tolist():  # one, but for a doc_id of several texts
                live[plausible(np.broadcast_to(sig[c], (len(members), hashes)), sig[members], least)] = True
            yield from t.select(["centre", "id"]).cast(_PAIR).take(pa.array(members[live])).to_batches()

    return run


def _verify(size: int, threshold: int):
    """Members of a block that are linked to their centre, on full sets."""
    def run(batches):
        hasher = C.SpanHash(30)
        for t in _groups(batches, ["centre", "blk"]):
            is_centre = t.column("is_centre").to_numpy(zero_copy_only=False)
            centres = t.filter(pa.array(is_centre))
            d, g = shingles(*C.text_buffer(centres.column("payload")), size, hasher)
            sets = np.split(g, np.searchsorted(d, np.arange(1, centres.num_rows)))
            for part in C.chunks(t.filter(pa.array(~is_centre)), "payload"):
                d, g = shingles(*C.text_buffer(part.column("payload")), size, hasher)
                count = np.bincount(d, minlength=part.num_rows)
                linked = np.zeros(part.num_rows, bool)
                for own in sets:
                    place = np.minimum(np.searchsorted(own, g), max(len(own) - 1, 0))
                    shared = own[place] == g if len(own) else np.zeros(len(g), bool)
                    both = np.bincount(d[shared], minlength=part.num_rows)
                    linked |= (both > 0) & (100 * both >= threshold * (len(own) + count - both))
                yield from part.select(["centre", "id"]).cast(_PAIR).take(pa.array(np.flatnonzero(linked))).to_batches()

    return run


def block_links(t: pa.Table, size: int, threshold: int, hasher: C.SpanHash) -> list[dict]:
    """Links of a block's probes to its other rows that join different components, verified on full sets.

    A pair that shares an earlier band is left to that band's bucket.  Rows of
    one component, also of one that a link has just made, are not compared.
    """
    probe = t.column("probe").to_numpy(zero_copy_only=False)
    ids, label, band = t.column("id").to_numpy(), t.column("comp").to_numpy().copy(), int(t.column("band")[0].as_py())
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
    least = least_matches(threshold, sig.shape[1])
    doc, g = shingles(*C.text_buffer(t.column("text")), size, hasher)
    values, code = np.unique(g, return_inverse=True)
    head = np.searchsorted(doc, np.arange(len(ids) + 1))
    mark, out, others = np.zeros(len(values), bool), [], np.flatnonzero(~probe)
    for i in np.flatnonzero(probe).tolist():
        j = others[label[others] != label[i]]
        if band and len(j):
            j = j[~(sig[j, :ROWS * band] == sig[i, :ROWS * band]).reshape(len(j), band, ROWS).all(axis=2).any(axis=1)]
        if len(j):
            j = j[plausible(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], least)]
        own = code[head[i]:head[i + 1]]
        mark[own] = True
        for x in j.tolist():
            if label[x] == label[i]:
                continue
            theirs = code[head[x]:head[x + 1]]
            both = int(np.count_nonzero(mark[theirs]))
            if both and 100 * both >= threshold * (len(own) + len(theirs) - both):
                out.append({"a": int(min(ids[i], ids[x])), "b": int(max(ids[i], ids[x]))})
                label[label == label[x]] = label[i]
        mark[own] = False
    return out


def _meet(size: int, threshold: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        hasher = C.SpanHash(30)
        for t in _groups(batches, ["key", "r", "d"]):
            yield pa.RecordBatch.from_pylist(block_links(t, size, threshold, hasher), schema)

    return run


def _by_centre(pairs: DataFrame, payload: DataFrame, fn) -> DataFrame:
    """``fn`` over blocks of a centre's members; ``pairs``: centre, id (written); ``payload``: id, payload, bytes (written).

    A block has about ``BLOCK`` members or ``BLOCK_BYTES`` of payload, and its centre's once.
    """
    members = C.keep(pairs.join(payload.groupBy("id").agg(F.sum("bytes").alias("bytes")), "id"), "minhash-pairs")
    total = members.count()
    blocks = members.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).alias("blocks"))
    blocks = C.keep(blocks, "minhash-blocks")
    rows = C.meet(members.drop("bytes"), blocks, ["centre"], total).select("centre", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("blk"), "id", F.lit(False).alias("is_centre"))
    rows = rows.unionByName(blocks.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("blk"), F.col("centre").alias("id"), F.lit(True).alias("is_centre")))
    parts = C.parts_for(pairs.sparkSession, total, 20 * BLOCK)
    rows = rows.join(payload.drop("bytes"), "id").repartition(parts, "centre", "blk").sortWithinPartitions("centre", "blk", "is_centre")
    return rows.mapInArrow(fn, "centre long, id long")


def classes(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """k, dk, n_shingles, component (smallest ``id_key`` reachable) of every row of doc_id and text."""
    return _classes(docs.select(C.id_key().alias("k"), *_text_and_hash()), shingle, threshold)


def _text_and_hash() -> list[Column]:
    return [F.xxhash64(F.coalesce("text", F.lit(""))).alias("dk"), F.col("text").cast("string").alias("text")]


def _classes(d: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """As ``classes``, of documents k (rows k, dk, text)."""
    spark = d.sparkSession
    hashes = band_count(threshold) * ROWS
    base = C.keep(d.mapInArrow(_sets(shingle, hashes), "k long, dk long, n_shingles long, s1 long, s2 long, sig binary, bands array<long>"), "minhash-sets")
    some = base.filter("n_shingles > 0")
    of_set = ["s1", "s2", "n_shingles"]
    firsts = C.keep(some.groupBy(*of_set).agg(F.min("k").alias("id"), F.count(F.lit(1)).alias("copies")), "minhash-firsts")
    equal = (some.select("k", *of_set).join(firsts.filter("copies > 1"), of_set).filter("k <> id")
             .select(F.col("k").alias("a"), F.col("id").alias("b")).distinct())

    # buckets of two sets or more; a set is present through its smallest document
    ids = some.join(firsts, (some.k == firsts.id) & (some.s1 == firsts.s1) & (some.s2 == firsts.s2) & (some.n_shingles == firsts.n_shingles)).select("id", "dk", "sig", "bands").dropDuplicates(["id", "dk"])
    ids = C.keep(ids, "minhash-ids")
    rows = ids.select("id", F.posexplode("bands").alias("band", "value")).select("id", "band", F.xxhash64("band", "value").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("key", "n")
    members = C.keep(rows.join(sizes, "key"), "minhash-members")
    popular = members.groupBy("id").agg(F.sum("n").alias("popular"))
    centre = members.join(popular, "id").groupBy("key").agg(F.max_by("id", F.struct("popular", -F.col("id"))).alias("centre"))
    members = members.select("key", "band", "id")
    stars = C.keep(members.join(centre, "key").filter("id <> centre").select("centre", "id").distinct(), "minhash-stars")

    candidates = members.select("id").distinct()
    texts = C.keep(d.join(candidates, d.k == candidates.id, "left_semi").select(F.col("k").alias("id"), "text"), "minhash-texts")
    sig = ids.select("id", "sig")
    close = _by_centre(stars, sig.select("id", F.col("sig").alias("payload"), F.lit(4 * hashes).alias("bytes")), _prune(threshold, hashes))
    close = C.keep(close.distinct(), "minhash-close")
    linked = _by_centre(close, texts.select("id", F.col("text").alias("payload"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), _verify(shingle, threshold))
    star_links = C.keep(linked.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "minhash-star-links")
    labels = components(star_links.unionByName(equal)).withColumnsRenamed({"node": "id", "component": "comp"})

    # buckets that hold more than one component
    labelled = members.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    labelled = C.keep(labelled, "minhash-labelled")
    of_comp = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_keys = (of_comp.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"))
                 .filter("comps > 1").select("key", "n", F.col("main.comp").alias("main"), (F.col("n") - F.col("main.n")).alias("n_out")))
    lengths = texts.groupBy("id").agg(F.sum(F.octet_length("text")).alias("bytes"))
    rest = labelled.join(open_keys, "key").join(lengths, "id")
    weight = rest.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("comp") != F.col("main"), F.col("bytes"))).alias("bytes_out"))
    most = lambda n, b: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(b) / BLOCK_BYTES))
    rest = rest.drop("bytes").join(weight, "key").withColumns({"r_blocks": most("n_out", "bytes_out"), "d_blocks": most("n", "bytes"), "h": F.xxhash64("id")})
    here = lambda c: F.pmod("h", F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    probes = rest.filter("comp <> main").select("key", "band", "id", "comp", F.lit(True).alias("probe"), here("r_blocks").alias("r"), every("d_blocks").alias("d"))
    others = rest.select("key", "band", "id", "comp", F.lit(False).alias("probe"), every("r_blocks").alias("r"), here("d_blocks").alias("d"))
    blocks = probes.unionByName(others).join(sig, "id").join(texts, "id")
    parts = C.parts_for(spark, base.count(), 20 * BLOCK)
    near = blocks.repartition(parts, "key", "r", "d").sortWithinPartitions("key", "r", "d").mapInArrow(_meet(shingle, threshold), "a long, b long")
    rest_links = C.keep(near.distinct(), "minhash-rest-links")
    found = C.keep(components(star_links.unionByName(rest_links).unionByName(equal)), "minhash-classes")
    return (base.select("k", "dk", "n_shingles").join(found, F.col("k") == F.col("node"), "left")
            .select("k", "dk", "n_shingles", F.coalesce("component", "k").alias("component")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (is it the document's own)."""
    real = lambda c: F.when(F.col(c) != C.NULL_ID, F.col(c))
    return classes(docs, shingle, threshold).select(real("k").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("k") == F.col("component")).alias("kept"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose document is its class's smallest, with their columns.

    Documents are (doc_id, text): where a doc_id has several texts, the pairs are numbered
    in their order and the numbers are classed.  Rows equal in both all stay or go.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), C.id_key().alias("k"), *_text_and_hash())
    pairs = C.keep(rows.select("k", "dk").distinct(), "minhash-pairs")
    if pairs.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        gone = _classes(rows.select("k", "dk", "text"), shingle, threshold).filter("k <> component").select("k", "dk")
    else:
        parts = C.parts_for(docs.sparkSession, pairs.count(), 1_000_000)
        numbers = pairs.repartitionByRange(parts, "k", "dk").sortWithinPartitions("k", "dk").withColumn("number", F.monotonically_increasing_id())
        numbers = C.keep(numbers, "minhash-numbers")
        numbered = rows.join(numbers, ["k", "dk"]).select(F.col("number").alias("k"), "dk", "text")
        later = _classes(numbered, shingle, threshold).filter("k <> component").select(F.col("k").alias("number"))
        gone = numbers.join(later.distinct(), "number").select("k", "dk")
    return rows.join(gone.distinct(), ["k", "dk"], "left_anti").select("_row.*")
