"""Exact k-nearest-neighbour join.

Every query row is matched against the reference rows of its own group
(equi keys, normally ``(tenant_id, table_name)``) under the squared distance
F10: ``sum(((xq - xt) / s)^2)`` over numerics with the group's scale ``s``, plus
per categorical feature 0 (equal, null = null) / 2 (different, query value
known) / 1 (query value unseen).  Distances are never rounded before ranking or
voting: equal features, and only they, are at distance 0; ties go to the smaller
id.

A model that is fitted and scored in one run is searched in tiles of a group (``knn_join``): the
steps below, without 2, run there in numpy on the tile's rows.  A model that is saved or serves a stream has
an index (``build_index``), and its queries go through the plan (``knn_probe``):

1. Agreement cells.  For each subset S of the categorical features, the rows of
   a group with equal values on S form a cell, ordered by the first numeric
   feature.  The penalty of a pair falls as its agreement grows, so a true
   neighbour that agrees with the query on exactly S is among the k numerically
   nearest rows of the query's cell of S: any nearer row of that cell is at
   least as near in total.
2. Index.  References are range-partitioned by (cell, value); the place in the sorted
   partition, with the counts of earlier partitions added, is a row's position in
   its cell, so a hot cell (a whole tenant) is counted by many tasks.  Rows are
   written in blocks of positions, and the value of every ``MARK``-th position
   apart from them.  The index of the cells that agree on all features belongs to the
   references: it is built once and kept in a model; queries only sort themselves
   among the marks.
3. Candidates.  The last mark before a query tells its position up to ``MARK`` - 1
   rows; the query joins the blocks around it on ``(cell, block)``: a number of rows
   for each subset that depends on k only, whatever the group's size or its
   distribution.  A pair counts in the cell of its exact agreement only, hence once.
4. Fewer agreements.  A pair that agrees on S only is at least at the penalty of the
   other features.  Only queries whose k-th distance so far reaches that penalty go on
   to S, and of the references only the rows of these queries' cells are indexed: subsets
   that miss one or two features first, the others last.
5. With more than one numeric feature the candidates only bound the k-th
   distance; the rows that can be nearer lie, for each subset whose penalty is
   within the bound, in a range of the first numeric feature, and are joined by
   position blocks in the same way.

A dense vector feature has no such order: its pairs are evaluated in tiles of
query and reference blocks (matrix products bound them, the near ones are summed), see
``knn_vectors``.

Top-k is ``row_number() <= k`` per query; Catalyst plans a partial
WindowGroupLimit before the shuffle, and the query id is a unique key, so no
partition holds more than one query's candidates per map task.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.features import categorical_penalty
from ledgerlens.session import discard, materialize

SCORE_DECIMALS = 9   # vote scores are shares of the group's votes, so this is relative
BLOCK = 16           # positions of a cell per block of the index
MARK = 8             # every so many positions a value is marked
REF_ROWS = 1 << 18   # references of a tile
QUERY_ROWS = 1 << 17  # and its queries
QUERY_SLICE = 1 << 14  # searched at once
PAIRS = 1 << 20      # pairs compared at once
TILE_ROWS = 8192     # rows of a block of vectors
SLICE = 256          # queries of a tile compared at once


def _sq(c: Column) -> Column:
    return c * c


def pair_d2(a: str, b: str, n_num: int, n_cat: int, known: str | None, scale: str | None = None) -> Column:
    """Squared distance between the row prefixed ``a`` and the row prefixed ``b``.

    ``known``: prefix of a's known-value flags (None: all known).  ``scale``: prefix of the
    divisors of numeric differences (None: 1).
    """
    terms = []
    for i in range(n_num):
        d = F.col(f"{a}n{i}") - F.col(f"{b}n{i}")
        terms.append(_sq(d / F.col(f"{scale}{i}") if scale else d))
    for i in range(n_cat):
        terms.append(categorical_penalty(f"{a}c{i}", f"{b}c{i}", F.col(f"{known}{i}") if known else F.lit(True)))
    return reduce(operator.add, terms) if terms else F.lit(0.0)


def _cells(df: DataFrame, keys, prefix: str, n_cat: int, subsets) -> DataFrame:
    """One row per given subset of categorical features: ``subset`` (bits) and the cell as two 64-bit hashes.

    ``_all`` has the bits of features that the group does not use: all its rows agree on them.
    """
    tokens = [F.when(F.col(f"{prefix}c{i}").isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), F.col(f"{prefix}c{i}"))) for i in range(n_cat)]
    cells = []
    for s in subsets:
        parts = [F.col(k) for k in keys] + [F.lit(s)] + [t for i, t in enumerate(tokens) if s >> i & 1]
        cell = F.struct(F.lit(s).alias("subset"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))
        cells.append(F.when(F.lit(s).bitwiseAND(F.col("_all")) == F.col("_all"), cell))
    out = [c for c in df.columns if c != "_all"]
    return df.select("*", F.explode(F.array_compact(F.array(*cells))).alias("_c")).select(*out, "_c.subset", "_c.h1", "_c.h2")


def _masked(df: DataFrame, side: str, keys, masks: DataFrame | None, num_mask, cat_mask, n_num: int, n_cat: int) -> DataFrame:
    """Features that a row's group does not use made equal in all its rows; the bits of categorical ones in ``_all``.

    Of numerics those that the group uses come first (with their scales): the first one orders the
    cells, and a constant there would leave every row of a cell within reach.
    """
    if masks is None:
        return df.withColumn("_all", F.lit(0))
    m = masks.select(*keys, *[F.col(c).alias(f"_mn{i}") for i, c in enumerate(num_mask)], *[F.col(c).alias(f"_mc{i}") for i, c in enumerate(cat_mask)])
    out = df.join(m, list(keys), "left")
    use = lambda c: F.coalesce(F.col(c), F.lit(True))
    scaled = f"{side}s0" in df.columns
    used = F.array_compact(F.array(*[F.when(use(f"_mn{i}"), F.struct(F.col(f"{side}n{i}").alias("x"), (F.col(f"{side}s{i}") if scaled else F.lit(1.0)).alias("s")))
                                     for i in range(n_num)]))
    if n_num:
        out = out.withColumn("_used", used)
    for i in range(n_num):
        one = F.get("_used", F.lit(i))
        out = out.withColumn(f"{side}n{i}", F.when(one.isNull(), F.lit(0.0)).otherwise(one["x"]))
        if scaled:
            out = out.withColumn(f"{side}s{i}", F.coalesce(one["s"], F.lit(1.0)))
    for i in range(n_cat):
        out = out.withColumn(f"{side}c{i}", F.when(use(f"_mc{i}"), F.col(f"{side}c{i}")))
    bits = [F.when(use(f"_mc{i}"), F.lit(0)).otherwise(F.lit(1 << i)) for i in range(n_cat)]
    return out.withColumn("_all", reduce(operator.add, bits) if bits else F.lit(0)).select(*df.columns, "_all")


def _steps(n_cat: int) -> list[list[int]]:
    """The subsets of categorical features in the order they are searched: all agree, one or two do not, the others."""
    missing = lambda s: n_cat - s.bit_count()
    return [x for lo, hi in ((0, 0), (1, 2), (3, n_cat)) if (x := [s for s in range(1 << n_cat) if lo <= missing(s) <= hi])]


@dataclass
class Index:
    """References of all groups by cell of full agreement and position, built once for any number of queries."""

    rows: DataFrame   # keys, h1, h2, block, pos, t_id, t_label, tn<i>, tc<i>
    marks: DataFrame  # keys, h1, h2, x, pos of every MARK-th position
    keep: int         # equal rows of a cell that are kept: serves k up to this, less one for excluded self
    more: Callable[[list[int], DataFrame], Index] | None = field(default=None, repr=False)  # the index of other subsets, of given cells (h1, h2)

    def tables(self) -> tuple[DataFrame, DataFrame]:
        return self.rows, self.marks


def build_index(refs: DataFrame, *, keys, t_id: str, t_label: str, num=(), cat=(), masks: DataFrame | None = None,
                num_mask=(), cat_mask=(), keep: int, subsets=None, only: DataFrame | None = None) -> Index:
    """The index of ``refs`` (see ``knn_join`` for the columns) for up to ``keep`` neighbours.

    ``subsets``: of categorical features that agree (None: all features); ``only``: the cells wanted.
    """
    keys = list(keys)
    n_num, n_cat = len(num), len(cat)
    t = refs.select(*keys, F.col(t_id).alias("t_id"), F.col(t_label).alias("t_label"),
                    *[F.col(c).cast("double").alias(f"tn{i}") for i, c in enumerate(num)],
                    *[F.col(c).cast("string").alias(f"tc{i}") for i, c in enumerate(cat)])
    t = _masked(t, "t", keys, masks, num_mask, cat_mask, n_num, n_cat)
    cells = _cells(t, keys, "t", n_cat, _steps(n_cat)[0] if subsets is None else subsets).withColumn("x", F.col("tn0") if n_num else F.lit(0.0)).drop("subset")
    if only is not None:
        cells = cells.join(only, ["h1", "h2"], "left_semi")
    # of equal rows of a cell only the smallest ids can be neighbours; values come first, as sorting by what differs most is fast
    equal = Window.partitionBy(*[f"tn{i}" for i in range(n_num)], "h1", "h2").orderBy("t_id")
    cells = cells.withColumn("_r", F.row_number().over(equal)).filter(F.col("_r") <= keep).drop("_r")
    parts = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "x", "t_id"]
    ranged = cells.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "knn_ranges")
    earlier = Window.partitionBy("h1", "h2").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = (ranged.groupBy("h1", "h2", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
                     .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    placed = ranged.join(offsets, ["h1", "h2", "_part"])
    placed = placed.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first") + 1).withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)).drop("_at", "_first", "_before", "_part")
    placed = materialize(placed, "knn_index")
    discard(ranged)
    index = Index(placed.drop("x"), placed.filter((F.col("pos") - 1) % MARK == 0).select(*keys, "h1", "h2", "x", "pos"), keep)
    how = {"keys": keys, "t_id": t_id, "t_label": t_label, "num": num, "cat": cat, "masks": masks, "num_mask": num_mask, "cat_mask": cat_mask, "keep": keep}
    index.more = lambda others, wanted: build_index(refs, subsets=others, only=wanted, **how)
    return index


def _located(marks: DataFrame, probes: DataFrame) -> DataFrame:
    """Adds ``pos`` to probes (h1, h2, x, ``side`` -1: before equal values, 1: after them).

    It is the last marked position before the probe: of the references before it at least
    ``pos``, at most ``pos`` + MARK - 1 stand in the cell.
    """
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = marks.select("h1", "h2", "x", "pos").withColumn("side", F.lit(0)).unionByName(probes, allowMissingColumns=True)
    ranged = materialize(both.repartitionByRange(parts, "h1", "h2", "x", "side").withColumn("_part", F.spark_partition_id()), "knn_probes")
    earlier = Window.partitionBy("h1", "h2").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = ranged.groupBy("h1", "h2", "_part").agg(F.max("pos").alias("_n")).withColumn("_before", F.max("_n").over(earlier)).drop("_n")
    inside = Window.partitionBy("_part", "h1", "h2").orderBy("x", "side").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_in", F.max("pos").over(inside)).filter("side <> 0").join(offsets, ["h1", "h2", "_part"])
    return placed.withColumn("pos", F.coalesce(F.greatest("_in", "_before"), F.lit(0).cast("long"))).select(*probes.columns, "pos")


def _blocks(first: Column, last: Column) -> Column:
    """Blocks of positions ``first..last`` (counted from 0), empty if there are none."""
    lo = F.greatest(first, F.lit(0).cast("long"))
    return F.when(last >= lo, F.sequence(F.floor(lo / BLOCK), F.floor(last / BLOCK))).otherwise(F.array().cast("array<bigint>"))


def knn_probe(index: Index, queries: DataFrame, *, keys, q_id: str, num=(), scale=(), cat=(), known=(), masks: DataFrame | None = None,
              num_mask=(), cat_mask=(), k: int = 7, k_col: str | None = None, exclude_self: bool = False) -> DataFrame:
    """The k nearest rows of an index per query row, see ``knn_join``; the index is not sorted again.

    ``k_col``: a query-side column with the row's own number of neighbours, at most ``k``.
    """
    keys = list(keys)
    n_num, n_cat = len(num), len(cat)
    keep = k + (1 if exclude_self else 0)
    if keep > index.keep:
        raise ValueError(f"the index serves {index.keep} neighbours, not {keep}")
    q = queries.select(*keys, F.col(q_id).alias("q_id"), (F.col(k_col).cast("int") if k_col else F.lit(k)).alias("q_k"),
                       *[F.col(c).cast("double").alias(f"qn{i}") for i, c in enumerate(num)],
                       *[(F.col(scale[i]).cast("double") if scale else F.lit(1.0)).alias(f"qs{i}") for i in range(n_num)],
                       *[F.col(c).cast("string").alias(f"qc{i}") for i, c in enumerate(cat)],
                       *[(F.col(known[i]) if known else F.lit(True)).alias(f"qk{i}") for i in range(n_cat)])
    q = materialize(_masked(q, "q", keys, masks, num_mask, cat_mask, n_num, n_cat), "knn_queries")
    penalty = reduce(operator.add, [F.when(F.col("subset").bitwiseAND(1 << i) > 0, F.lit(0.0)).when(F.col(f"qk{i}"), F.lit(2.0)).otherwise(F.lit(1.0))
                                    for i in range(n_cat)], F.lit(0.0))

    def matched(rows: DataFrame, probes: DataFrame) -> DataFrame:
        """Pairs of probes (with from, to: positions from 0) and references, each in the cell of its agreement."""
        p = probes.select("*", F.explode(_blocks(F.col("from"), F.col("to"))).alias("block")).drop("x", "side", "pos")
        pairs = p.join(rows.drop(*keys), ["h1", "h2", "block"]).filter((F.col("pos") - 1).between(F.col("from"), F.col("to")))
        bits = [F.col(f"qc{i}").eqNullSafe(F.col(f"tc{i}")).cast("int") * (1 << i) for i in range(n_cat)]
        pairs = pairs.filter(F.col("subset") == (reduce(operator.add, bits) if bits else F.lit(0)))
        if exclude_self:
            pairs = pairs.filter(F.col("q_id") != F.col("t_id"))
        return pairs.withColumn("d2", pair_d2("q", "t", n_num, n_cat, "qk", "qs"))

    def top(pairs: DataFrame) -> DataFrame:
        w = Window.partitionBy("q_id", *keys).orderBy("d2", "t_id")
        best = pairs.select(*keys, "q_id", "q_k", "t_id", "t_label", "d2").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        return best.filter(F.col("rank") <= F.col("q_k")) if k_col else best

    def bounded(rows: DataFrame) -> DataFrame:
        """Rows of queries with their k-th distance so far (``bound``; infinite if there are fewer than k)."""
        b = best.groupBy(*keys, "q_id").agg(F.max("d2").alias("bound"), F.count(F.lit(1)).alias("_n"), F.max("q_k").alias("_k"))
        b = b.select(*keys, "q_id", F.when(F.col("_n") >= F.col("_k"), F.col("bound")).alias("bound"))
        return rows.join(b, ["q_id", *keys], "left").select(*rows.columns, F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def within(probes: DataFrame) -> DataFrame:
        """The probes (with ``bound``) that reach their cell."""
        return probes.withColumn("_left", F.col("bound") - penalty).filter(F.col("_left") >= 0)

    best, searched, pos = None, [], F.col("pos")
    for subsets in _steps(n_cat):
        if best is not None:
            best = materialize(best, "knn_best")
        # without numerics the smallest ids are nearest: the query stands before them
        qc = _cells(q if best is None else bounded(q), keys, "q", n_cat, subsets).withColumn("x", F.col("qn0") if n_num else F.lit(-1.0)).withColumn("side", F.lit(1))
        if best is None:
            here = index
        else:
            qc = materialize(within(qc).drop("bound", "_left"), "knn_open")
            if qc.isEmpty():  # every other cell is farther than the k-th neighbour
                continue
            here = index.more(subsets, qc.select("h1", "h2").distinct())
        searched.append((here, qc))
        # the nearest positions: equal values stand in order of ids, at most `keep` of them,
        # so 2 keep - 1 rows below and at the query's value hold the `keep` nearest of that side
        near = _located(here.marks, qc).withColumn("from", pos - (2 * keep - 1)).withColumn("to", pos + (MARK - 1) + (keep - 1))
        found = top(matched(here.rows, near))
        best = found if best is None else top(best.drop("rank").unionByName(found.drop("rank")))

    # several numerics: all rows of the range that the k-th distance leaves open
    if n_num > 1:
        best = materialize(best, "knn_bound")
        ranges = None
        for here, qc in searched:
            wide = within(bounded(qc.drop("x", "side")))
            reach = F.sqrt("_left") * F.col("qs0") * (1 + 1e-9)
            ends = wide.select("*", F.explode(F.array(F.struct(F.lit(-1).alias("side"), (F.col("qn0") - reach).alias("x")),
                                                      F.struct(F.lit(1).alias("side"), (F.col("qn0") + reach).alias("x")))).alias("_e")).select(*wide.columns, "_e.*")
            by = [c for c in qc.columns if c not in ("x", "side")] + ["bound"]
            span = _located(here.marks, ends).groupBy(*by).agg(F.min("pos").alias("from"), (F.max("pos") + (MARK - 2)).alias("to"))
            found = top(matched(here.rows, span).filter(F.col("d2") <= F.col("bound")))
            ranges = found if ranges is None else ranges.unionByName(found)
        best = top(ranges.drop("rank"))
    return best.select(*keys, "q_id", "rank", "t_id", "t_label", "d2", F.round(F.sqrt("d2"), 6).alias("distance"))


def knn_join(queries: DataFrame, refs: DataFrame, *, keys, q_id: str, t_id: str, t_label: str,
             num=(), scale=(), cat=(), known=(), masks: DataFrame | None = None,
             num_mask=(), cat_mask=(), k: int = 7, k_col: str | None = None, exclude_self: bool = False) -> DataFrame:
    """Exact k nearest reference rows per query row, within equal ``keys``; no index is made (see ``knn_probe``).

    ``num``: numeric columns; ``scale``: query-side divisors, one per ``num`` (empty = 1);
    ``cat``: categorical columns; ``known``: query-side boolean columns, one per ``cat``
    (empty = every value known).  Optional ``masks``: one row per group with boolean columns
    ``num_mask``/``cat_mask`` (feature used in that group).  ``k_col``: a query-side column with
    the row's own number of neighbours, at most ``k``.

    Rows of a group meet in tiles of at most about ``QUERY_ROWS`` queries and ``REF_ROWS`` references, in which
    the search by agreement cells and positions runs in numpy (``_nearest``); a tile returns
    the k nearest of each query, and a window merges the tiles.

    Returns ``(keys..., q_id, rank, t_id, t_label, d2, distance)``, ``rank`` 1..k ordered by
    ``(d2, t_id)``; ``distance = round(sqrt(d2), 6)``.
    """
    keys = list(keys)
    n_num, n_cat = len(num), len(cat)
    q = queries.select(*keys, F.col(q_id).alias("q_id"), (F.col(k_col).cast("int") if k_col else F.lit(k)).alias("q_k"),
                       *[F.col(c).cast("double").alias(f"qn{i}") for i, c in enumerate(num)],
                       *[(F.col(scale[i]).cast("double") if scale else F.lit(1.0)).alias(f"qs{i}") for i in range(n_num)],
                       *[F.col(c).cast("string").alias(f"qc{i}") for i, c in enumerate(cat)],
                       *[(F.col(known[i]) if known else F.lit(True)).alias(f"qk{i}") for i in range(n_cat)])
    t = refs.select(*keys, F.col(t_id).alias("t_id"), F.col(t_label).alias("t_label"),
                    *[F.col(c).cast("double").alias(f"tn{i}") for i, c in enumerate(num)],
                    *[F.col(c).cast("string").alias(f"tc{i}") for i, c in enumerate(cat)])
    if exclude_self:  # a row without an id is not known to be another
        q, t = q.filter(F.col("q_id").isNotNull()), t.filter(F.col("t_id").isNotNull())
    q = materialize(_masked(q, "q", keys, masks, num_mask, cat_mask, n_num, n_cat).drop("_all"), "knn_queries")
    many = lambda df, rows, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("long").alias(name))
    counts = materialize(many(q, QUERY_ROWS, "_nq").join(many(t, REF_ROWS, "_nt"), keys), "knn_blocks")
    t = _masked(t, "t", keys, masks, num_mask, cat_mask, n_num, n_cat).drop("_all")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    tiles = counts.agg(F.sum(F.col("_nq") * F.col("_nt"))).first()[0] or 0
    # several parts a tile, as few tiles would else meet in some parts and leave others empty
    parts = max(min(4 * tiles, 1000), tiles, int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [*keys, "qb", "tb"]
    q_tiles = q.join(counts, keys).withColumn("qb", own("q_id", "_nq")).withColumn("tb", every("_nt")).drop("_nq", "_nt").repartition(parts, *by).groupBy(*by)
    t_tiles = t.join(counts, keys).withColumn("tb", own("t_id", "_nt")).withColumn("qb", every("_nq")).drop("_nq", "_nt").repartition(parts, *by).groupBy(*by)
    schema = T.StructType([*[q.schema[c] for c in [*keys, "q_id", "q_k"]], t.schema["t_id"], t.schema["t_label"], T.StructField("d2", T.DoubleType())])

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.name for f in schema.fields]
        if not left.num_rows or not right.num_rows:
            cols = {**{c: left[c] for c in [*keys, "q_id", "q_k"]}, **{c: right[c] for c in ("t_id", "t_label")}, "d2": pa.chunked_array([[]], pa.float64())}
            return pa.table({c: cols[c].slice(0, 0) for c in names})
        right = right.take(pc.array_sort_indices(right["t_id"].combine_chunks(), null_placement="at_start"))
        codes = [_codes(left[f"qc{f}"], right[f"tc{f}"]) for f in range(n_cat)]
        tcode = qcode = None
        if exclude_self:
            both = [c.cast(pa.string()) if left["q_id"].type != right["t_id"].type else c for c in (left["q_id"], right["t_id"])]
            qcode, tcode, _ = _codes(*both)
        search = _Tile(right.num_rows, [right[f"tn{f}"].to_numpy() for f in range(n_num)], [c[1] for c in codes], [c[2] for c in codes], tcode)
        out = []
        for a in range(0, left.num_rows, QUERY_SLICE):
            part = left.slice(a, QUERY_SLICE)
            side = slice(a, a + part.num_rows)
            i, j, d2 = search.nearest([part[f"qn{f}"].to_numpy() for f in range(n_num)], [part[f"qs{f}"].to_numpy() for f in range(n_num)], [c[0][side] for c in codes],
                                      [part[f"qk{f}"].to_numpy() for f in range(n_cat)], part["q_k"].to_numpy(), None if qcode is None else qcode[side], k)
            cols = {**{c: part[c].take(i) for c in [*keys, "q_id", "q_k"]}, **{c: right[c].take(j) for c in ("t_id", "t_label")}, "d2": pa.chunked_array([d2], pa.float64())}
            out.append(pa.table({c: cols[c] for c in names}))
        return pa.concat_tables(out)

    found = q_tiles.cogroup(t_tiles).applyInArrow(tile, schema)
    w = Window.partitionBy("q_id", *keys).orderBy("d2", "t_id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if k_col:
        best = best.filter(F.col("rank") <= F.col("q_k"))
    return best.select(*keys, "q_id", "rank", "t_id", "t_label", "d2", F.round(F.sqrt("d2"), 6).alias("distance"))


def _codes(q: pa.ChunkedArray, t: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the values of both sides, equal for equal values and 0 for null, and one more than the largest."""
    both = pa.concat_arrays([*q.chunks, *t.chunks]).dictionary_encode()
    code = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return code[:len(q)], code[len(q):], len(both.dictionary) + 1


def _search(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, v: np.ndarray, after: bool) -> np.ndarray:
    """Per row the first place in ``lo..hi`` of ``x`` (sorted there) that is not below ``v``, or with ``after`` above it."""
    lo, hi = lo.copy(), hi.copy()
    while (some := lo < hi).any():
        mid = (lo + hi) >> 1
        at = x[np.where(some, mid, 0)]
        up = some & ((at <= v) if after else (at < v))
        lo, hi = np.where(up, mid + 1, lo), np.where(some & ~up, mid, hi)
    return lo


class _Tile:
    """References of one group, in the order of their ids, and the search of their nearest ones.

    It is the search that the module describes, in memory: each subset of the categorical
    features that a query can agree on orders the references once by (cell, numerics).
    """

    def __init__(self, rows: int, num: list[np.ndarray], cat: list[np.ndarray], sizes: list[int], ids: np.ndarray | None):
        self.rows, self.num, self.cat, self.sizes, self.ids = rows, num, cat, sizes, ids
        self.x = num[0] if num else np.zeros(rows)
        self.orders: dict[int, np.ndarray] = {}

    def cells(self, subset: int, cat: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The cells of queries and references, as numbers."""
        n, width = len(cat[0]) if cat else 0, 1
        both = np.zeros(n + self.rows, np.int64)
        for f, size in enumerate(self.sizes):
            if subset >> f & 1:
                if width * size >= 1 << 62:
                    values, both = np.unique(both, return_inverse=True)
                    width = len(values)
                both, width = both * size + np.concatenate([cat[f], self.cat[f]]), width * size
        return both[:n], both[n:]

    def order(self, subset: int, cell: np.ndarray, keep: int) -> np.ndarray:
        """References by (cell, numerics, id); of rows that are equal there only the ``keep`` smallest ids can be neighbours."""
        if subset not in self.orders:
            by = [cell, *self.num]
            order = np.lexsort(by[1:][::-1] + by[:1])
            new = np.ones(self.rows, bool)
            new[1:] = reduce(operator.or_, [c[order][1:] != c[order][:-1] for c in by])
            first = np.flatnonzero(new)
            place = np.arange(self.rows) - np.repeat(first, np.diff(np.append(first, self.rows)))
            self.orders[subset] = order[place < keep].astype(np.int32)
        return self.orders[subset]

    def nearest(self, num, scale, cat, known, own: np.ndarray, ids: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, reference, squared distance) of the ``own`` (at most ``k``) nearest references of each query."""
        n, n_cat = len(own), len(self.cat)
        x = num[0] if num else np.full(n, -1.0)  # without numerics the smallest ids are nearest: the query stands before them
        keep = k if ids is None else k + int(np.bincount(self.ids).max())  # rows of its own id may stand among the nearest
        fixed = sum(1 << f for f in range(n_cat) if len(np.unique(self.cat[f])) == 1 and (cat[f] == self.cat[f][0]).all())  # all agree there
        levels = [[s for s in range(1 << n_cat) if s & fixed == fixed and n_cat - s.bit_count() == missing] for missing in range(n_cat + 1)]
        bound = np.full(n, np.inf)

        def penalty(s: int) -> np.ndarray:
            return reduce(operator.add, [np.where(known[f], 2.0, 1.0) for f in range(n_cat) if not s >> f & 1], np.zeros(n))

        def places(s: int, rows: np.ndarray):
            """The order of a subset, the values in it, and where the cells of the queries begin and end."""
            q_cell, t_cell = self.cells(s, cat) if n_cat else (np.zeros(n, np.int64), np.zeros(self.rows, np.int64))
            order = self.order(s, t_cell, keep)
            cell = t_cell[order]
            return order, self.x[order], np.searchsorted(cell, q_cell[rows], "left"), np.searchsorted(cell, q_cell[rows], "right")

        def pairs(s: int, rows: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray):
            """Pairs of each query and the references at its places, of those that agree on ``s`` only and are within the bound."""
            size = np.maximum(hi - lo, 0)
            ends, start, out = np.cumsum(size), 0, []
            while start < len(rows):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
                m = size[start:stop]
                i = np.repeat(rows[start:stop], m)
                j = order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[start:stop], m)]
                apart = np.ones(len(i), bool) if ids is None else ids[i] != self.ids[j]
                for f in range(n_cat):
                    if not s >> f & 1:
                        apart &= cat[f][i] != self.cat[f][j]
                i, j = i[apart], j[apart]
                d2 = np.zeros(len(i))  # summed in the order of ``pair_d2``
                for f in range(len(num)):
                    d = (num[f][i] - self.num[f][j]) / scale[f][i]
                    d2 = d2 + d * d
                for f in range(n_cat):
                    if not s >> f & 1:
                        d2 = d2 + np.where(known[f][i], 2.0, 1.0)
                near = ~(d2 > bound[i])
                out.append((i[near], j[near], d2[near]))
                start = stop
            return out

        def best(found):
            i, j, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((j, d2, i))
            i, j, d2 = i[order], j[order], d2[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < own[i]
            return i[top], j[top], d2[top]

        none = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))
        top = none
        with np.errstate(all="ignore"):
            for subsets in levels:
                found = [top]
                for s in subsets:
                    rows = np.flatnonzero(bound - penalty(s) >= 0)
                    if len(rows):
                        order, values, a, b = places(s, rows)
                        at = _search(values, a, b, x[rows], after=True)
                        # equal values stand in order of ids, at most `keep` of them, so 2 keep - 1 rows below and at the
                        # query's value hold the `keep` nearest of that side
                        found += pairs(s, rows, order, np.maximum(at - (2 * keep - 1), a), np.minimum(at + keep, b))
                top = best(found)
                count = np.bincount(top[0], minlength=n)
                full = count >= own
                bound[full] = top[2][np.cumsum(count)[full] - 1]
            if len(num) > 1:  # all rows of the range that the k-th distance leaves open
                found = [none]
                for s in (s for subsets in levels for s in subsets):
                    left = bound - penalty(s)
                    rows = np.flatnonzero(left >= 0)
                    if len(rows):
                        order, values, a, b = places(s, rows)
                        reach = np.sqrt(left[rows]) * scale[0][rows] * (1 + 1e-9)
                        found += pairs(s, rows, order, _search(values, a, b, x[rows] - reach, after=False), _search(values, a, b, x[rows] + reach, after=True))
                top = best(found)
        return top


def _near_pairs(q: np.ndarray, t: np.ndarray, k: int, never: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance) of the pairs that can be among the k nearest of a row of ``q``, summed in the order of the vector.

    ``never``: pairs left out.  Where a product is not finite, all pairs of the row are summed.
    """
    with np.errstate(all="ignore"):
        square = (q * q).sum(1)[:, None] + (t * t).sum(1)[None, :]
        about = square - 2.0 * (q @ t.T)
        # both sums round by less than this: each adds some 4 times the dimension of products, none above the squares
        off = 8.0 * (q.shape[1] + 4) * np.finfo(float).eps * square + np.finfo(float).tiny
        upper = about + off
        if never is not None:
            upper[never] = np.inf
        n = min(k, len(t))
        limit = np.partition(upper, n - 1, axis=1)[:, n - 1]
        limit[~np.isfinite(upper).all(axis=1) if never is None else ~(np.isfinite(upper) | never).all(axis=1)] = np.inf
        near = ~(about - off > limit[:, None])
        if never is not None:
            near &= ~never
        i, j = np.nonzero(near)
        d2 = np.zeros(len(i))
        for c in range(q.shape[1]):
            d2 += np.square(q[i, c] - t[j, c])
    return i, j, d2


def knn_vectors(queries: DataFrame, refs: DataFrame, *, keys, q_id: str, t_id: str, t_label: str, vec: str,
                k: int = 7, exclude_self: bool = False) -> DataFrame:
    """``knn_join`` over a dense vector: exact squared Euclidean distance, in tiles.

    In many dimensions no order prunes pairs, so all pairs of a group are evaluated, block by
    block (``TILE_ROWS`` rows a side) in numpy; a tile returns its ``k`` best rows per query.
    A matrix product tells every distance up to a bound on its rounding; the pairs that this
    leaves open are summed in the order of the vector, as the result is defined.
    Rows without a vector have no neighbours and are none.
    """
    keys = list(keys)

    def side(df: DataFrame, id_col: str, label, is_query: bool) -> DataFrame:
        return df.filter(F.col(vec).isNotNull()).select(*keys, F.col(id_col).alias("id"), label.alias("label"), F.col(vec).alias("v"), F.lit(is_query).alias("is_query"))

    both = side(queries, q_id, F.lit(None).cast("string"), True).unionByName(side(refs, t_id, F.col(t_label).cast("string"), False))
    blocks = both.groupBy(*keys).agg(*[F.ceil(F.count_if(F.col("is_query") == flag) / TILE_ROWS).alias(c) for c, flag in (("nq", True), ("nt", False))])
    h = F.xxhash64("id")
    all_of = lambda c: F.sequence(F.lit(0).cast("long"), F.greatest(F.col(c), F.lit(1)) - 1)
    own = lambda c: F.array(F.pmod(h, F.greatest(F.col(c), F.lit(1))))
    tiles = (both.join(blocks, keys)
             .withColumn("qb", F.explode(F.when(F.col("is_query"), own("nq")).otherwise(all_of("nq"))))
             .withColumn("tb", F.explode(F.when(F.col("is_query"), all_of("nt")).otherwise(own("nt")))).drop("nq", "nt"))
    schema = T.StructType([*[both.schema[c] for c in keys], T.StructField("q_id", both.schema["id"].dataType), T.StructField("t_id", both.schema["id"].dataType),
                           T.StructField("t_label", T.StringType()), T.StructField("d2", T.DoubleType())])

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        qs, ts = pdf[pdf["is_query"]], pdf[~pdf["is_query"]].sort_values("id")
        if not len(qs) or not len(ts):
            return pd.DataFrame({f.name: [] for f in schema.fields}).astype({"d2": float})
        q, t = (np.stack(x["v"].to_numpy()).astype(float) for x in (qs, ts))
        q_ids, t_ids, labels = qs["id"].to_numpy(), ts["id"].to_numpy(), ts["label"].to_numpy()
        out = []
        for a in range(0, len(q), SLICE):
            i, j, d2 = _near_pairs(q[a:a + SLICE], t, k, q_ids[a:a + SLICE, None] == t_ids[None, :] if exclude_self else None)
            order = np.lexsort((j, d2, i))  # equal distances: smaller id first
            i, j, d2 = i[order], j[order], d2[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j, d2 = i[best], j[best], d2[best]
            out.append(pd.DataFrame({"q_id": q_ids[a + i], "t_id": t_ids[j], "t_label": labels[j], "d2": d2}))
        res = pd.concat(out)
        for c in keys:
            res[c] = pdf[c].iloc[0]
        return res[np.isfinite(res["d2"])][[f.name for f in schema.fields]]

    pairs = tiles.groupBy(*keys, "qb", "tb").applyInPandas(tile, schema)
    w = Window.partitionBy(*keys, "q_id").orderBy("d2", "t_id")
    return (pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                 .select(*keys, "q_id", "rank", "t_id", "t_label", "d2", F.round(F.sqrt("d2"), 6).alias("distance")))


def vote(neighbors: DataFrame, keys, weights: str | DataFrame = "distance") -> DataFrame:
    """Class vote over the k neighbours of each query.

    uniform: weight 1.  distance: weight ``1/d``; if any neighbour is at
    distance 0, only those vote (weight 1).  ``score`` is the class's share of
    all weights; winner by (score desc, label asc).  ``weights`` may be a table
    ``(keys, weights)`` with the weighting of each group.
    Returns ``(keys..., q_id, prediction, score)``.
    """
    keys = list(keys)
    wq = Window.partitionBy("q_id", *keys)
    near = F.min("d2").over(wq)
    # relative to the nearest, so the scale of the features does not matter
    by_distance = F.when(near == 0, F.when(F.col("d2") == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.sqrt(near / F.col("d2")))
    if isinstance(weights, DataFrame):
        neighbors = neighbors.join(weights.select(*keys, F.col("weights").alias("_how")), keys)
        w = F.when(F.col("_how") == "uniform", F.lit(1.0)).when(F.col("_how") == "distance", by_distance).otherwise(F.raise_error(F.concat(F.lit("unknown weights "), F.coalesce("_how", F.lit("null")))).cast("double"))
    elif weights == "uniform":
        w = F.lit(1.0)
    elif weights == "distance":
        w = by_distance
    else:
        raise ValueError(f"unknown weights {weights!r}")
    s = (neighbors.withColumn("_w", w).withColumn("_w", F.col("_w") / F.sum("_w").over(wq))
         .groupBy(*keys, "q_id", "t_label").agg(F.round(F.sum("_w"), SCORE_DECIMALS).alias("score")))
    win = s.groupBy(*keys, "q_id").agg(F.min_by(F.struct("t_label", "score"), F.struct((-F.col("score")).alias("a"), F.col("t_label").alias("b"))).alias("_w"))
    return win.select(*keys, "q_id", F.col("_w.t_label").alias("prediction"), F.col("_w.score").alias("score"))


def distance_stats(neighbors: DataFrame, keys) -> DataFrame:
    """Min / max / avg neighbour distance per query."""
    return neighbors.groupBy(*keys, "q_id").agg(
        F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"),
        F.round(F.avg("distance"), 6).alias("avg_distance"))
