"""Model selection: sampling, folds, mutual information, cross-validation, backward
elimination (T5-T7, W6, W7, A10, A27-A29, C7-C10).

Random orders are md5 orders of ``id || '|' || seed`` (declared divergence
D1): deterministic, identical in every engine, and computable per row.

Cross-validation of every configuration of a round is one job with one task per
(group, fold): the distance is a sum of per-feature terms, a candidate feature
subset only adds up fewer of them, its neighbours are searched in a range of one
numeric feature, and k in {3,5,7,9} are prefixes of one top-9 list.  It runs on the selection sample, at most ``SELECTION_SAMPLE_ROWS``
(10 000) labelled rows of a group, so a task's input is bounded.  Mutual
information and folds take all rows they are given; ranks in a group are counted
over range partitions.
"""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.config import (BEST_MINIMAL_TOLERANCE, CV_FOLDS, CV_SEED, EARLY_STOP_ROUNDS,
                               ELIMINATION_TOLERANCE, SELECTION_K_OPTIONS, SELECTION_MIN_PER_CLASS,
                               SELECTION_SAMPLE_ROWS, SELECTION_WEIGHT_OPTIONS)
from ledgerlens.operators.profile import selection_guards
from ledgerlens.session import materialize

ACC_DECIMALS = 9
SALTS = 64         # parts in which a hot group is ranked for its sample
LEAD_DIGITS = 3    # hex digits of the md5 order by which the rows of a sample are found
SCORE_ROWS = 32    # rows searched at once in a task
NEAR_ROWS = 256    # reference rows a side that bound the distance of a block's neighbours


def md5_order(id_col: str, seed: int = CV_SEED) -> Column:
    """The deterministic shuffle key of a row."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def sample_min_per_class(df: DataFrame, keys, target: str, id_col: str, *,
                         num_samples: int = SELECTION_SAMPLE_ROWS, min_per_class: int = SELECTION_MIN_PER_CLASS,
                         seed: int = CV_SEED) -> DataFrame:
    """Per group, ``min(n_c, m)`` rows of every class, filled to ``num_samples``.

    Groups with at most ``num_samples`` rows are kept whole.  Of larger ones only the rows
    that can be among the first are ranked (``_first_rows``), in ``SALTS`` hashed parts first,
    each of which keeps ``num_samples`` rows, so no task sorts a whole group.  Class minima
    above ``num_samples`` are an error (T6).
    """
    keys = list(keys)
    r = df.withColumn("_key", md5_order(id_col, seed)).withColumn("_lead", F.coalesce(F.substring("_key", 1, LEAD_DIGITS), F.lit("")))  # a null key is first
    counts = materialize(r.groupBy(*keys, target, "_lead").agg(F.count(F.lit(1)).alias("_n")), "sample_counts")
    over = (counts.groupBy(*keys, target).agg(F.least(F.sum("_n"), F.lit(min_per_class)).alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("_m"))
                  .filter(F.col("_m") > num_samples).limit(1).collect())
    if over:
        raise ValueError(f"{over[0]['_m']} rows are needed for {min_per_class} of each class, the sample has {num_samples}")
    ng = counts.groupBy(*keys).agg(F.sum("_n").alias("_ng"))
    wc = Window.partitionBy(*keys, target).orderBy("_key", id_col)
    ws = Window.partitionBy(*keys, "_salt").orderBy("_key", id_col)
    wt = Window.partitionBy(*keys).orderBy("_key", id_col)
    wanted = num_samples
    while True:
        first = materialize(_first_rows(r, counts, keys, target, wanted, min_per_class), "sample_first")
        head = first.withColumn("_cr", F.row_number().over(wc)).filter(F.col("_cr") <= min_per_class).drop("_cr")
        rest = first.join(head.select(*keys, id_col), keys + [id_col], "left_anti")
        nh = head.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nh"))
        # an id of several rows leaves the rest with all of them: then more rows are needed to fill the sample
        here = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("_here")).join(ng, keys).filter(F.col("_here") < F.col("_ng"))
        there = rest.filter("_early").groupBy(*keys).agg(F.count(F.lit(1)).alias("_there"))
        short = here.join(nh, keys).join(there, keys, "left").filter(F.coalesce("_there", F.lit(0)) < F.lit(num_samples) - F.col("_nh"))
        if short.isEmpty():
            break
        wanted *= 4
    salted = rest.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    few = salted.withColumn("_sr", F.row_number().over(ws)).filter(F.col("_sr") <= num_samples).drop("_sr", "_salt")
    tail = few.withColumn("_tr", F.row_number().over(wt)).filter(F.col("_tr") <= num_samples)
    tail = tail.join(nh, keys).filter(F.col("_tr") <= F.lit(num_samples) - F.col("_nh")).drop("_tr", "_nh")
    small = first.join(ng.filter(F.col("_ng") <= num_samples), keys, "left_semi")
    big = head.unionByName(tail).join(ng.filter(F.col("_ng") > num_samples), keys, "left_semi")
    return small.unionByName(big).drop("_key", "_early")


def _first_rows(r: DataFrame, counts: DataFrame, keys, target: str, wanted: int, per_class: int) -> DataFrame:
    """Rows of ``r`` that begin the md5 order, by its first digits ``_lead``: the first ``wanted`` of a group (``_early``) and
    ``per_class`` of each class, with all that share their last digits.  ``counts``: rows by group, class and ``_lead``."""
    earlier = Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)  # over counts, 16 ** LEAD_DIGITS at most
    def last(by, some):
        before = F.coalesce(F.sum("_n").over(earlier.partitionBy(*by)), F.lit(0))
        return counts.groupBy(*by, "_lead").agg(F.sum("_n").alias("_n")).select(*by, "_lead", before.alias("_before")).filter(F.col("_before") < some).groupBy(*by).agg(F.max("_lead").alias("_last"))
    ends = last([*keys, target], per_class).withColumnRenamed("_last", "_class_last").join(last(keys, wanted), keys)
    ends = ends.select(F.struct(*keys, target).alias("_g"), "_class_last", "_last")
    early = F.col("_lead") <= F.col("_last")
    return (r.join(ends, F.struct(*keys, target).eqNullSafe(F.col("_g"))).filter(early | (F.col("_lead") <= F.col("_class_last")))
             .withColumn("_early", early).drop("_lead", "_g", "_class_last", "_last"))


def stratified_folds(df: DataFrame, keys, target: str, id_col: str, *, folds: int = CV_FOLDS,
                     seed: int = CV_SEED) -> DataFrame:
    """fold = (rank of the row in its class by md5 order - 1) mod folds.

    Class sizes per fold differ by at most one.
    """
    rows = df.withColumn("_key", md5_order(id_col, seed)).withColumn("_n", F.lit(1))
    placed = _running(rows, [*keys, target], ["_key", id_col], "cv_folds")
    return placed.select(*df.columns, ((F.col("_to") - 1) % folds).cast("int").alias("fold"))


#: Rows of a range partition, whose windows one task sorts.
RANGE_ROWS = 500_000


def _range_parts(written: DataFrame) -> int:
    """Range partitions of a written table: as many as shuffles have, more where it is large, so that none grows with it."""
    return max(int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-written.count() // RANGE_ROWS))


def _dealt(df: DataFrame, parts: int, *by) -> DataFrame:
    """Dealt by columns into ``parts`` tasks, where these are more than shuffles have."""
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _running(df: DataFrame, group, order, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``_to``: the sum of ``_n`` over the rows of the group up to this one's ``order`` (equals included), and ``_below``: without the equals.

    Counted over range partitions, so no task takes a whole group.  ``parts``: how many (see ``_range_parts``).
    """
    group = list(group)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), name)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    before = (ranged.groupBy(*group, "_part").agg(F.sum("_n").alias("_s"))
                    .select(F.struct(*group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_part", *group).orderBy(*order)  # rows of equal order included; they are in one partition
    equal = Window.partitionBy("_part", *group, *order)
    return (_dealt(ranged, parts, "_part").withColumn("_in", F.sum("_n").over(inside)).withColumn("_eq", F.sum("_n").over(equal))
                  .join(before, F.struct(*group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
                  .withColumn("_to", F.col("_before") + F.col("_in")).withColumn("_below", F.col("_to") - F.col("_eq")).drop("_g", "_p", "_part", "_in", "_before", "_eq"))


def _value_counts(df: DataFrame, keys, target: str, numeric) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of numeric features: counts (keys, feature, v, y, _n); their values with places (_below, _to); medians (_rows, _some, _med)."""
    vals = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in numeric])
    counts = materialize(df.select(*keys, F.col(target).cast("string").alias("y"), F.explode(vals).alias("_v"))
                           .groupBy(*keys, "_v.feature", "_v.v", "y").agg(F.count(F.lit(1)).alias("_n")), "mi_counts")
    by = [*keys, "feature"]
    some = F.col("v").isNotNull()
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_rows"), F.sum(F.when(some, F.col("_n")).otherwise(0)).alias("_some"))
    placed = materialize(_running(counts.filter(some), by, ["v"], "mi_ranges", _range_parts(counts)), "mi_positions")
    at = lambda pos: F.min(F.when((F.col("_below") <= pos) & (pos < F.col("_to")), F.col("v")))
    low, high = F.floor((F.col("_some") - 1) / 2), F.floor(F.col("_some") / 2)
    med = placed.join(sizes, by).groupBy(*by).agg((at(low) * 0.5 + at(high) * 0.5).alias("_med"))
    return counts, placed, materialize(sizes.join(med, by, "left"), "mi_medians")


def _binned(df: DataFrame, keys, target: str, numeric, bins: int) -> DataFrame:
    """(keys, feature, x: the bin, y, nxy) of numeric features, from counts of their distinct values."""
    by = [*keys, "feature"]
    some = F.col("v").isNotNull()
    counts, placed, med = _value_counts(df, keys, target, numeric)
    below_med = placed.join(med, by).filter(F.col("v") < F.col("_med")).groupBy(*by).agg(F.sum("_n").alias("_below"))
    nulls = F.col("_rows") - F.col("_some")
    given = placed.join(med, by).withColumn("_rank", F.col("_below") + F.when(F.col("_med") < F.col("v"), nulls).otherwise(0))
    missing = (counts.filter(~some).join(med, by).join(below_med, by, "left").withColumn("_rank", F.coalesce("_below", F.lit(0))))
    x = F.floor(F.col("_rank") * F.lit(float(bins)) / F.col("_rows")).cast("string").alias("x")
    cols = [*by, x, "y", "_n"]
    return given.select(*cols).unionByName(missing.select(*cols)).groupBy(*by, "x", "y").agg(F.sum("_n").alias("nxy"))


#: Neighbours of the numeric estimator (fixed value), and places of a class in one block.
MI_NEIGHBORS = 3
MI_BLOCK = 4096


def _medians(counts: DataFrame, by: list[str]) -> DataFrame:
    """Median ``_med`` of the values ``v``, each ``_n`` times, per group, from counted places; groups with a null value only are needed, and given."""
    null = F.col("v").isNull()
    gaps = counts.groupBy(*by).agg(F.count_if(null).alias("_gaps"), F.sum(F.when(null, 0).otherwise(F.col("_n"))).alias("_some")).filter("_gaps > 0 AND _some > 0")
    values = counts.join(gaps.select(*by, "_some"), by).filter(~null).groupBy(*by, "v", "_some").agg(F.sum("_n").alias("_n"))
    placed = _running(values, by, ["v"], "mi_gaps")
    at = lambda pos: F.min(F.when((F.col("_below") <= pos) & (pos < F.col("_to")), F.col("v")))
    low, high = F.floor((F.col("_some") - 1) / 2), F.floor(F.col("_some") / 2)
    return placed.groupBy(*by).agg((at(low) * 0.5 + at(high) * 0.5).alias("_med"))


def digamma(n: Column) -> Column:
    """Digamma of positive integers: ten steps up, then the asymptotic series (error below 1e-12)."""
    x = n.cast("double") + 10
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6) + 1 / (240 * x ** 8)
    return series - reduce(operator.add, [1 / (n + i) for i in range(10)])


def _digamma(n: np.ndarray) -> np.ndarray:
    """``digamma`` of an array."""
    x = n.astype(float) + 10
    series = np.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6) + 1 / (240 * x ** 8)
    return series - sum(1 / (n + i) for i in range(10))


def _segments(t: pa.Table, by) -> np.ndarray:
    """Numbers from 0 of the groups of sorted rows."""
    new = np.zeros(t.num_rows, bool)
    for c in by:
        code = t[c].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _near_in_range(by, k: int, schema):
    """Sorted values of a range (by, x, y, n_y, _n) -> per group ``_rows`` and ``_sum`` of the rows whose neighbourhood is in the range, and
    (y, n_y, x, _n, _open) of the others, with the values of their classes next to them and next to an open end of the range."""
    names = [f.name for f in schema.fields]

    def ranges(batches):
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        x, n, n_y = (t[c].to_numpy() for c in ("x", "_n", "n_y"))
        y = t["y"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seg = _segments(t, by)
        of_class = seg * (y.max() + 1) + y
        kk = np.minimum(k, n_y - 1)

        # distance to the kk-th row of the class; more than k + 1 rows of one value make no difference
        order = np.argsort(of_class, kind="stable")
        times = np.minimum(n[order], k + 1)
        v, g = np.repeat(x[order], times), np.repeat(of_class[order], times)
        p = np.cumsum(times) - times
        away = np.full((len(x), 2 * k), np.inf)
        for i in range(1, k + 1):
            for j, q in ((2 * i - 2, p - i), (2 * i - 1, p + i)):
                there = (q >= 0) & (q < len(v))
                there[there] = g[q[there]] == g[p[there]]
                away[there, j] = np.abs(v[p[there]] - v[q[there]])
        r = np.empty(len(x))
        r[order] = np.sort(away, axis=1)[np.arange(len(x)), kk[order] - 1]

        # known is what ends before the range does, where the group goes on behind it
        starts = np.searchsorted(seg, np.arange(seg[-1] + 1))
        ends = np.append(starts[1:], len(seg))
        low, high = x[starts][seg], x[ends - 1][seg]
        from_start, to_end = seg > 0, seg < seg[-1]  # a group inside a range is whole
        known = np.isfinite(r)
        known &= from_start | (r == 0) | ((x - low >= r) & (x - r >= low))
        known &= to_end | (r == 0) | ((high - x >= r) & (x + r <= high))
        upto, m = np.append(0, np.cumsum(n)), np.zeros(len(x), np.int64)
        for a, b in zip(starts, ends, strict=True):
            s = x[a:b]
            zero = r[a:b] == 0
            first = np.where(zero, np.searchsorted(s, s), np.searchsorted(s, s - r[a:b], "right"))
            after = np.where(zero, np.searchsorted(s, s, "right"), np.searchsorted(s, s + r[a:b]))
            m[a:b] = upto[a + after] - upto[a + first]
        w = np.where(known, n, 0)
        value = np.zeros(len(x))
        value[known] = (_digamma(kk) - _digamma(n_y) - _digamma(np.maximum(m, 1)))[known] * w[known]
        sums = t.select(by).take(pa.array(starts)).to_pydict() | {"_rows": np.add.reduceat(w, starts), "_sum": np.add.reduceat(value, starts)}

        # kept for the open rows: k values of the class on each side, and k at an end behind which the group may go on
        c = of_class[order]
        at = np.arange(len(c))
        first = np.searchsorted(c, c)
        last = np.searchsorted(c, c, "right") - 1
        unknown = np.flatnonzero(~known[order])
        keep = np.zeros(len(c), bool)
        for i in range(-k, k + 1):
            i = np.clip(unknown + i, 0, len(c) - 1)
            keep[i[c[i] == c[unknown]]] = True
        keep |= (~from_start[order] & (at - first < k)) | (~to_end[order] & (last - at < k))
        kept = order[keep]
        rows = t.select([*by, "y", "n_y", "x", "_n"]).take(pa.array(kept)).append_column("_open", pa.array(~known[kept]))
        fields = [pa.field(c, t.schema.field(c).type) for c in by] + [pa.field("y", pa.string()), pa.field("n_y", pa.int64()), pa.field("x", pa.float64()), pa.field("_n", pa.int64()), pa.field("_open", pa.bool_()), pa.field("_rows", pa.int64()), pa.field("_sum", pa.float64())]
        for part in (pa.table(sums), rows):
            cols = [part[f.name].cast(f.type) if f.name in part.column_names else pa.nulls(part.num_rows, f.type) for f in fields]
            yield from pa.table(cols, schema=pa.schema(fields)).select(names).to_batches(max_chunksize=10_000)

    return ranges


def _places_in_range(by, schema):
    """Sorted values and ends of a range (by, at, side, _n, _row, ...) -> ``_in``: the values up to each end, and per group a line with ``_all`` of them."""
    names = [f.name for f in schema.fields]

    def ranges(batches):
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        n, seg, is_end = t["_n"].to_numpy(), _segments(t, by), t["side"].to_numpy() != 1
        starts = np.searchsorted(seg, np.arange(seg[-1] + 1))
        upto = np.cumsum(np.where(is_end, 0, n))
        total = np.diff(np.append(np.append(0, upto)[starts], upto[-1]))
        inside = upto - np.append(0, upto)[starts][seg]
        t = t.append_column("_in", pa.array(inside)).append_column("_all", pa.nulls(len(seg), pa.int64()))
        ends = t.filter(pa.array(is_end))
        groups = t.take(pa.array(starts))
        groups = groups.set_column(groups.column_names.index("_all"), "_all", pa.array(total)).set_column(groups.column_names.index("_row"), "_row", pa.nulls(len(starts), pa.int64()))
        for part in (ends, groups):
            yield from part.select(names).to_batches(max_chunksize=10_000)

    return ranges


def mi_nearest(df: DataFrame, keys, target: str, numeric, id_col: str, k: int = MI_NEIGHBORS) -> DataFrame:
    """A29 for numeric features by nearest neighbours: ``(keys, feature, mi)``.

    Each row takes the distance r to the k-th nearest row of its own class and counts the m rows of
    the group nearer than r (itself included; the equal ones, if r is 0); classes of one row are
    left out; k is at most the class's other rows.  With n rows of which n_y are of the row's class,
    ``mi = digamma(n) + mean digamma(k) - mean digamma(n_y) - mean digamma(m)``, at least 0.  Null
    values take the group's median (A10).  No noise is added, so equal values stay equal.

    All rows count, equal values of a class at once.  Values are dealt into ranges of a group's
    order; a range solves the rows whose r does not reach beyond it.  The others are solved over
    ranges of their own: neighbours stand at most k places away in the class's order, cut in blocks
    with k rows of overlap; the m rows are a difference of two places in the group's order.  So a
    group or class of any size is spread over tasks.
    """
    keys = list(keys)
    group = [*keys, "feature"]
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias("v")) for c in numeric])
    counts = materialize(df.select(*keys, F.col(target).cast("string").alias("y"), F.explode(each).alias("_v")).groupBy(*keys, "_v.feature", "y", "_v.v").agg(F.count(F.lit(1)).alias("_n")), "mi_values")
    med = _medians(counts, group)
    sizes = counts.groupBy(*group, "y").agg(F.sum("_n").alias("n_y")).filter("n_y > 1")
    rows = materialize(counts.join(med, group, "left").join(sizes, [*group, "y"]).select(*group, "y", "n_y", F.coalesce("v", "_med", F.lit(0.0)).alias("x"), "_n"), "mi_rows")
    parts = _range_parts(rows)

    # 1. rows whose neighbours are in the range of their value
    schema = T.StructType([rows.schema[c] for c in (*group, "y", "n_y", "x", "_n")] + T.StructType.fromDDL("_open boolean, _rows long, _sum double").fields)
    ranged = rows.repartitionByRange(parts, *group, "x").sortWithinPartitions(*group, "x")
    solved = materialize(ranged.mapInArrow(_near_in_range(group, k, schema), schema), "mi_solved")

    # 2. the k-th neighbour of the class for the others: a window over blocks that overlap by k rows
    of_class = [*group, "y"]
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k + 1)).cast("int"))).alias("_copy")
    kept = solved.filter("_open IS NOT NULL").withColumn("_id", F.monotonically_increasing_id()).select(*of_class, "n_y", "x", "_open", "_id", F.col("_n").alias("_times"), copies).withColumn("_n", F.lit(1))
    placed = _running(kept, of_class, ["x", "_id", "_copy"], "mi_class", parts).withColumn("pos", F.col("_to") - 1).drop("_n", "_to", "_below")
    own = F.floor(F.col("pos") / MI_BLOCK)
    near = F.array_distinct(F.array(own, F.floor((F.col("pos") + k) / MI_BLOCK), F.floor(F.greatest(F.col("pos") - k, F.lit(0)) / MI_BLOCK)))
    blocks = placed.withColumn("_own", own).withColumn("_block", F.explode(near))
    w = Window.partitionBy(*of_class, "_block").orderBy("pos")  # MI_BLOCK + 2 k rows
    away = [F.abs(F.col("x") - f("x", i).over(w)) for i in range(1, k + 1) for f in (F.lag, F.lead)]
    blocks = _dealt(blocks, parts, *of_class, "_block").withColumn("_d", F.array_sort(F.array_compact(F.array(*away)))).filter("_block = _own AND _open AND _copy = 1")
    kk = F.least(F.lit(k).cast("long"), F.col("n_y") - 1)
    radius = materialize(blocks.select(*group, "x", "n_y", "_times", kk.alias("k"), F.element_at("_d", kk.cast("int")).alias("r")).withColumn("_row", F.monotonically_increasing_id()), "mi_radius")

    # 3. their rows in (x - r, x + r): places of both ends in the group's order, side 0 before equal values, 2 behind them
    low = F.struct((F.col("x") - F.col("r")).alias("at"), F.when(F.col("r") > 0, F.lit(2)).otherwise(F.lit(0)).alias("side"), F.lit(-1).alias("sign"))
    high = F.struct((F.col("x") + F.col("r")).alias("at"), F.when(F.col("r") > 0, F.lit(0)).otherwise(F.lit(2)).alias("side"), F.lit(1).alias("sign"))
    ends = radius.select(*group, "_row", "k", "n_y", F.col("_times"), F.explode(F.array(low, high)).alias("_e")).select(*group, "_row", "k", "n_y", "_times", "_e.*", F.lit(0).cast("long").alias("_n"))
    both = rows.select(*group, F.col("x").alias("at"), F.lit(1).alias("side"), "_n").unionByName(ends, allowMissingColumns=True)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows.count() + 2 * radius.count()) // RANGE_ROWS))
    schema = T.StructType([both.schema[c] for c in (*group, "_row", "k", "n_y", "_times", "sign")] + T.StructType.fromDDL("_in long, _all long, _part int").fields)
    ranged = both.repartitionByRange(parts, *group, "at", "side").sortWithinPartitions(*group, "at", "side")
    places = materialize(ranged.withColumn("_part", F.spark_partition_id()).mapInArrow(_places_in_range(group, schema), schema), "mi_ends")
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a line per partition
    offsets = places.filter("_row IS NULL").select(*group, "_part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_off"))
    counted = (places.filter("_row IS NOT NULL").join(offsets, [*group, "_part"]).groupBy(*group, "_row", "k", "n_y", "_times")
                     .agg(F.sum(F.col("sign") * (F.col("_off") + F.col("_in"))).alias("m")))
    others = counted.select(*group, F.col("_times").alias("_rows"), (F.col("_times") * (digamma(F.col("k")) - digamma(F.col("n_y")) - digamma(F.col("m")))).alias("_sum"))
    total = solved.filter("_rows IS NOT NULL").select(*group, "_rows", "_sum").unionByName(others).groupBy(*group).agg(F.sum("_rows").alias("n"), F.sum("_sum").alias("_sum"))
    return total.select(*group, F.round(F.greatest(digamma(F.col("n")) + F.col("_sum") / F.col("n"), F.lit(0.0)), ACC_DECIMALS).alias("mi"))


def mutual_information(df: DataFrame, keys, target: str, categorical=(), numeric=(), bins: int = 10, id_col: str | None = None) -> DataFrame:
    """MI(feature; target) per group, ranked ascending (least informative first).

    Categorical: null is a category.  Numeric: null -> group median (A10), then by nearest
    neighbours (``mi_nearest``) where ``id_col`` is given, else in ``bins`` quantile bins by
    rank, equal values in one bin.  Counts all rows of ``df``, as the reference
    does before it samples.  Returns ``(keys, feature, mi, mi_rank)``.
    """
    keys = list(keys)
    wr = Window.partitionBy(*keys).orderBy("mi", "feature")
    if numeric and id_col is not None:
        mi = mi_nearest(df, keys, target, numeric, id_col)
        if categorical:
            mi = mi.unionByName(mutual_information(df, keys, target, categorical).drop("mi_rank"))
        return mi.withColumn("mi_rank", F.row_number().over(wr))
    tables = []
    if categorical:
        vals = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("x")) for c in categorical])
        long = df.select(*keys, F.col(target).cast("string").alias("y"), F.explode(vals).alias("_v")).select(*keys, "y", "_v.feature", "_v.x")
        tables.append(long.groupBy(*keys, "feature", "x", "y").agg(F.count(F.lit(1)).alias("nxy")))
    if numeric:
        tables.append(_binned(df, keys, target, numeric, bins))
    nxy = materialize(tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1]), "mi_pairs")  # read four times below
    nx = nxy.groupBy(*keys, "feature", "x").agg(F.sum("nxy").alias("nx"))
    ny = nxy.groupBy(*keys, "feature", "y").agg(F.sum("nxy").alias("ny"))
    n = nxy.groupBy(*keys, "feature").agg(F.sum("nxy").alias("n"))
    j = nxy.join(nx, keys + ["feature", "x"], "left").join(ny, keys + ["feature", "y"]).join(n, keys + ["feature"])
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    mi = j.groupBy(*keys, "feature").agg(F.round(F.sum(term), ACC_DECIMALS).alias("mi"))
    return mi.withColumn("mi_rank", F.row_number().over(wr))


def _nearest(d2: np.ndarray, k: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k smallest values of each row, by (value, place of the column), and these values."""
    k = min(k, d2.shape[1])
    limit = np.partition(d2, k - 1, axis=1)[:, k - 1]
    r, c = np.nonzero(d2 <= limit[:, None])
    v, c = d2[r, c], place[c]
    order = np.lexsort((c, v, r))
    first = np.searchsorted(r, np.arange(len(d2)))[:, None] + np.arange(k)
    return c[order][first], v[order][first]


def _distances(terms, rows, cols) -> np.ndarray:
    """Squared distances of query rows and reference rows: the sum of the terms, in their order."""
    total = 0.0
    for x, t, s in terms:
        if np.ndim(s):
            total = total + np.where(x[rows, None] == t[None, cols], 0.0, s[rows, None])
        else:
            total = total + np.square((x[rows, None] - t[None, cols]) / s)
    return total


def _search(terms, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest reference rows of every query, by (distance, row), and their squared distances.

    ``terms``: (query values, reference values, scale) of numeric features, (query codes, reference
    codes, penalty of each query, equal for equal codes) of categorical ones.  Queries stand in the order of a numeric
    feature; a reference row whose term of it alone is above the k-th distance to some others is no
    neighbour, so a block of queries reads a range of that order.  Without one, equal queries are searched once.
    """
    n_q, n_r = len(terms[0][0]), len(terms[0][1])
    k = min(k, n_r)
    at, near = np.empty((n_q, k), np.int64), np.empty((n_q, k))
    ordered = next((i for i, (x, t, s) in enumerate(terms) if not np.ndim(s) and np.isfinite(s) and np.isfinite(x).all() and np.isfinite(t).all() and t.min() < t.max()), None)
    if ordered is None:
        _, one, back = np.unique(np.column_stack([x for x, _, _ in terms]), axis=0, return_index=True, return_inverse=True)
        some = [(x[one], t, s[one] if np.ndim(s) else s) for x, t, s in terms]
        found = [_nearest(_distances(some, slice(a, a + SCORE_ROWS), slice(None)), k, np.arange(n_r)) for a in range(0, len(one), SCORE_ROWS)]
        return tuple(np.concatenate(f)[back.reshape(-1)] for f in zip(*found, strict=True))
    x, t, s = terms[ordered]
    queries, place = np.argsort(x, kind="stable"), np.argsort(t, kind="stable")
    terms = [(x, t[place], s) for x, t, s in terms]
    t = t[place]
    for i in range(0, n_q, SCORE_ROWS):
        rows = queries[i:i + SCORE_ROWS]
        v = x[rows]
        a, b = max(0, np.searchsorted(t, v[0]) - NEAR_ROWS), min(n_r, np.searchsorted(t, v[-1], "right") + NEAR_ROWS)
        d2 = _distances(terms, rows, slice(a, b))
        m = min(k, b - a)
        far = np.sqrt(np.partition(d2, m - 1, axis=1)[:, m - 1]) * s * (1 + 1e-9) + 1e-12 * np.abs(v) if m == k else np.full(len(v), np.inf)
        a2, b2 = np.searchsorted(t, (v - far).min()), np.searchsorted(t, (v + far).max(), "right")
        if a2 < a or b2 > b:
            a, b = min(a, a2), max(b, b2)
            d2 = _distances(terms, rows, slice(a, b))
        at[rows], near[rows] = _nearest(d2, k, place[a:b])
    return at, near


def _fold_scorer(keys, id_col, target, numeric, categorical, k_options, weight_options, schema):
    """(rows of a group with the fold to score, candidates) -> confusion counts of every configuration."""
    none = pd.DataFrame({f.name: pd.Series([], dtype="int64" if isinstance(f.dataType, T.IntegralType) else object) for f in schema.fields})

    def score(key, rows: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        is_q = (rows["fold"] == rows["fold_g"]).to_numpy()
        q, r = rows[is_q], rows[~is_q].sort_values(id_col)
        if not len(q) or not len(r) or not len(cands):
            return none
        labels = sorted(r[target].unique())
        code = {x: i for i, x in enumerate(labels)}
        r_label = r[target].map(code).to_numpy()
        parts = []  # (query values, reference values, scale) or (query codes, reference codes, penalty)
        for c in numeric:
            t = r[c].to_numpy(float)
            med = np.nanmedian(t) if not np.isnan(t).all() else 0.0
            t, x = np.where(np.isnan(t), med, t), q[c].to_numpy(float)
            parts.append((np.where(np.isnan(x), med, x), t, t.std() or 1.0))
        for c in categorical:
            codes, _ = pd.factorize(rows[c], use_na_sentinel=False)
            x, t = codes[is_q], codes[~is_q][np.argsort(rows[~is_q][id_col].to_numpy(), kind="stable")]
            parts.append((x, t, np.where(np.isin(x, t), 2.0, 1.0)))
        names = [*numeric, *categorical]
        truths = np.array([*labels, *sorted(set(q[target]) - set(labels))], object)  # classes that only the fold has come last
        truth_code = q[target].map({x: i for i, x in enumerate(truths)}).to_numpy()
        counts = {(cand, k, w): np.zeros((len(truths), len(labels)), np.int64) for cand in cands["cand"] for k in k_options for w in weight_options}
        for row in cands.itertuples(index=False):
            terms = [part for name, part in zip(names, parts, strict=True) if getattr(row, f"use_{name}")]
            at, near = _search(terms or [(np.zeros(len(q)), np.zeros(len(r)), 1.0)], max(k_options))
            lab = r_label[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                by_distance = np.where(near[:, :1] == 0, (near == 0).astype(float), np.sqrt(near[:, :1] / near))
            for w in weight_options:
                votes = np.ones_like(near) if w == "uniform" else by_distance
                total, done = np.zeros((len(near), len(labels))), 0
                for k in sorted(k_options):
                    for j in range(done, min(k, near.shape[1])):
                        total[np.arange(len(near)), lab[:, j]] += votes[:, j]
                    done = k
                    np.add.at(counts[row.cand, k, w], (truth_code, total.round(ACC_DECIMALS).argmax(axis=1)), 1)
        return pd.DataFrame([(*key[:-1], cand, k, w, key[-1], truths[i], labels[j], n[i, j]) for (cand, k, w), n in counts.items() for i, j in zip(*np.nonzero(n), strict=True)],
                            columns=[f.name for f in schema.fields])

    return score


def cv_confusion(sample: DataFrame, candidates: DataFrame, keys, *, id_col: str, target: str,
                 numeric=(), categorical=(), k_options=SELECTION_K_OPTIONS,
                 weight_options=SELECTION_WEIGHT_OPTIONS, folds: int = CV_FOLDS) -> DataFrame:
    """C7 per fold: confusion counts of every (candidate, k, weights), one neighbour pass per fold.

    ``sample`` is the selection sample (at most ``SELECTION_SAMPLE_ROWS`` rows per group) with a
    ``fold`` column; a task scores one fold of one group and searches each candidate's
    neighbours once (``_search``), for every k and weighting.  Numeric nulls
    are imputed by the training folds' median (C4, quirk Q2 fixed).
    Returns ``(keys, cand, k, weights, fold, y_true, y_pred, n)``, pairs that occur only.
    """
    keys = list(keys)
    each = F.explode(F.array(*[F.lit(i) for i in range(folds)])).alias("fold_g")
    rows = sample.select(*keys, id_col, target, *numeric, *categorical, "fold", each)
    cands = candidates.select(*keys, "cand", *[f"use_{c}" for c in [*numeric, *categorical]], each)
    schema = T.StructType([*[sample.schema[c] for c in keys], T.StructField("cand", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("weights", T.StringType()),
                           T.StructField("fold", T.IntegerType()), T.StructField("y_true", T.StringType()), T.StructField("y_pred", T.StringType()), T.StructField("n", T.LongType())])
    score = _fold_scorer(keys, id_col, target, tuple(numeric), tuple(categorical), tuple(k_options), tuple(weight_options), schema)
    return rows.groupBy(*keys, "fold_g").cogroup(cands.groupBy(*keys, "fold_g")).applyInPandas(score, schema)


def cv_fold_scores(sample: DataFrame, candidates: DataFrame, keys, **how) -> DataFrame:
    """C7/A27 per fold: ``(keys, cand, k, weights, fold, n_rows, n_correct)``, from ``cv_confusion``."""
    conf = cv_confusion(sample, candidates, keys, **how)
    return conf.groupBy(*keys, "cand", "k", "weights", "fold").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("n_correct"))


def cv_evaluate(sample: DataFrame, candidates: DataFrame, keys, **how) -> DataFrame:
    """Mean CV accuracy ``(keys, cand, k, weights, mean_accuracy, n_folds)``; see ``cv_fold_scores``."""
    per_fold = cv_fold_scores(sample, candidates, keys, **how)
    return per_fold.groupBy(*keys, "cand", "k", "weights").agg(
        F.round(F.avg(F.col("n_correct") / F.col("n_rows")), ACC_DECIMALS).alias("mean_accuracy"), F.count(F.lit(1)).alias("n_folds"))


def best_minimal(cv: DataFrame, keys, tol: float = BEST_MINIMAL_TOLERANCE) -> DataFrame:
    """Among configs within ``tol`` of the best mean accuracy, fewest features.

    ``cv`` needs ``n_features``; ties: higher accuracy, then smaller k, then
    'distance' before 'uniform', then candidate name.
    """
    keys = list(keys)
    best = cv.groupBy(*keys).agg(F.max("mean_accuracy").alias("_best"))
    ok = cv.join(best, keys).filter(F.col("mean_accuracy") >= F.col("_best") - F.lit(tol))
    w = Window.partitionBy(*keys).orderBy("n_features", F.col("mean_accuracy").desc(), "k", "weights", "cand")
    return ok.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_best")


def _candidate_masks(df: DataFrame, feats) -> DataFrame:
    """Add ``cand`` (sorted feature list as text), ``n_features`` and ``use_<f>`` flags."""
    out = df.withColumn("cand", F.array_join(F.array_sort("new_features"), ",")) \
            .withColumn("n_features", F.size("new_features"))
    for f in feats:
        out = out.withColumn(f"use_{f}", F.array_contains("new_features", F.lit(f)))
    return out


def check_must_have(must_have, features) -> None:
    """Features that must stay have to be features of the table."""
    if unknown := [f for f in must_have if f not in features]:
        raise ValueError(f"must-have features not found: {unknown}")


def must_have_violations(df: DataFrame, keys, must_have, features) -> DataFrame:
    """P16 as rows ``(keys, feature, problem)``: ``not_a_feature``, ``no_column``, ``no_value`` (none in the group), ``constant`` there."""
    keys = list(keys)
    there = [f for f in must_have if f in df.columns]
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[x for i, f in enumerate(there) for x in (F.count(f).alias(f"_n{i}"), (F.min(f) == F.max(f)).alias(f"_c{i}"))])
    found = []
    for f in must_have:
        if f not in features:
            problem = F.lit("not_a_feature")
        elif f not in there:
            problem = F.lit("no_column")
        else:
            i = there.index(f)
            problem = F.when(F.col(f"_n{i}") == 0, F.lit("no_value")).when(F.col(f"_c{i}") & (F.col(f"_n{i}") == F.col("_rows")), F.lit("constant"))
        found.append(F.struct(F.lit(f).alias("feature"), problem.alias("problem")))
    return stats.select(*keys, F.explode(F.array(*found)).alias("_p")).select(*keys, "_p.*").filter(F.col("problem").isNotNull())


def backward_elimination(df: DataFrame, keys, *, id_col: str, target: str, numeric=(), categorical=(),
                         must_have=(), tol: float = ELIMINATION_TOLERANCE,
                         early_stop: int = EARLY_STOP_ROUNDS, sample_rows: int = SELECTION_SAMPLE_ROWS,
                         folds: int = CV_FOLDS, seed: int = CV_SEED, max_rounds: int | None = None, with_rounds: bool = False):
    """Backward feature elimination for every group at once.

    The per-group state ``(keys, features, best, flat, active)`` is a
    DataFrame written under the checkpoint dir after every round.  Each round
    evaluates every drop-one candidate of every active group in one Spark job;
    the driver only asks whether any group is still active.  Decision rule per
    group: the first candidate in ascending-MI order that reaches the group's
    best accuracy wins; otherwise the best candidate within ``tol`` (quirk Q7
    fixed); otherwise the group stops.  ``early_stop`` rounds without strict
    improvement also stop it; so does reaching ``max(1, len(must_have))``
    features.

    Returns ``(cv_results, state)``: every evaluated config
    ``(keys, cand, k, weights, mean_accuracy, n_folds, n_features)`` and the
    final state ``(keys, features, best_accuracy)``.  ``with_rounds`` adds the decisions:
    ``(keys, round, dropped, accuracy, best_before, mi_rank, improved, features)``, a row per
    group and round; ``dropped`` is null where no candidate was good enough.
    """
    keys = list(keys)
    feats = sorted(list(numeric) + list(categorical))
    check_must_have(must_have, feats)
    min_feats = max(1, len(must_have))
    keep = F.array(*[F.lit(f) for f in must_have]) if must_have else F.array().cast("array<string>")
    # Groups that fail a guard are not searched
    guards = selection_guards(df, keys, target, folds=folds, k_max=max(SELECTION_K_OPTIONS), sample_rows=sample_rows, min_per_class=SELECTION_MIN_PER_CLASS)
    df = df.join(guards.filter("state = 'READY'").select(*keys), keys, "left_semi")
    sample = sample_min_per_class(df, keys, target, id_col, num_samples=sample_rows, seed=seed)
    sample = materialize(stratified_folds(sample, keys, target, id_col, folds=folds, seed=seed), "cv_sample")
    mi = materialize(mutual_information(df, keys, target, categorical, numeric, id_col=id_col), "cv_mi")

    def evaluate(cands: DataFrame) -> DataFrame:
        c = _candidate_masks(cands, feats)
        cv = cv_evaluate(sample, c, keys, id_col=id_col, target=target, numeric=numeric,
                         categorical=categorical, folds=folds)
        return materialize(cv.join(c.select(*keys, "cand", "n_features"), keys + ["cand"]), "cv_round")

    groups = sample.select(*keys).distinct()
    full = groups.withColumn("new_features", F.array(*[F.lit(f) for f in feats]))
    cv0 = evaluate(full)
    results = [cv0]
    state = materialize(
        cv0.groupBy(*keys).agg(F.max("mean_accuracy").alias("best"))
           .withColumn("features", F.array(*[F.lit(f) for f in feats]))
           .withColumn("flat", F.lit(0)).withColumn("active", F.lit(True)), "cv_state")
    rounds, history = 0, None
    while max_rounds is None or rounds < max_rounds:
        act = state.filter(F.col("active") & (F.size("features") > min_feats))
        if not act.limit(1).count():
            break
        rounds += 1
        cands = (act.select(*keys, "features", "best", "flat",
                            F.explode(F.array_except("features", keep)).alias("drop"))
                    .join(mi.select(*keys, F.col("feature").alias("drop"), "mi_rank"), keys + ["drop"])
                    .withColumn("new_features", F.array_remove("features", F.col("drop"))))
        cands = materialize(_candidate_masks(cands, feats), "cv_candidates")
        cv = evaluate(cands)
        results.append(cv)
        per = cv.groupBy(*keys, "cand").agg(F.max("mean_accuracy").alias("acc"))
        dec = (cands.join(per, keys + ["cand"])
                    .filter(F.col("acc") >= F.col("best") - F.lit(tol))
                    .withColumn("_imp", F.col("acc") >= F.col("best")))
        w = Window.partitionBy(*keys).orderBy(F.col("_imp").desc(), F.when(F.col("_imp"), F.col("mi_rank")),
                                              F.col("acc").desc(), "mi_rank")
        chosen = materialize(dec.withColumn("_r", F.row_number().over(w)).filter("_r = 1"), "cv_chosen")
        if with_rounds:
            said = act.select(*keys, F.col("best").alias("best_before"), F.col("features").alias("_old")).join(
                chosen.select(*keys, F.col("drop").alias("dropped"), F.col("acc").alias("accuracy"), "mi_rank", F.col("_imp").alias("improved"), "new_features"), keys, "left")
            said = materialize(said.select(*keys, F.lit(rounds).alias("round"), "dropped", "accuracy", "best_before", "mi_rank", "improved", F.array_sort(F.coalesce("new_features", "_old")).alias("features")), "cv_decisions")
            history = said if history is None else history.unionByName(said)
        flat = (F.when(F.col("acc") > F.col("best"), F.lit(0))
                 .when(F.col("_imp"), F.col("flat")).otherwise(F.col("flat") + 1))
        moved = chosen.select(*keys, F.col("new_features").alias("features"),
                              F.greatest("best", "acc").alias("best"), flat.alias("flat")) \
                      .withColumn("active", F.col("flat") < F.lit(early_stop))
        stopped = act.join(chosen.select(*keys), keys, "left_anti") \
                     .select(*keys, "features", "best", "flat", F.lit(False).alias("active"))
        untouched = state.join(act.select(*keys), keys, "left_anti") \
                         .select(*keys, "features", "best", "flat", F.lit(False).alias("active"))
        state = materialize(moved.unionByName(stopped).unionByName(untouched), "cv_state")
    cv_all = results[0]
    for r in results[1:]:
        cv_all = cv_all.unionByName(r)
    final = state.select(*keys, F.array_sort("features").alias("features"), F.col("best").alias("best_accuracy"))
    if not with_rounds:
        return cv_all, final
    if history is None:
        types = [*(sample.schema[c] for c in keys), *T.StructType.fromDDL("round int, dropped string, accuracy double, best_before double, mi_rank int, improved boolean, features array<string>").fields]
        history = df.sparkSession.createDataFrame([], T.StructType(types))
    return cv_all, final, history
