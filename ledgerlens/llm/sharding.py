"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows with equal text form a group that stays in one shard.  Groups are ordered
by their smallest doc_id; shards are contiguous in that order, and the largest
shard is as small as any contiguous cut allows: the smallest feasible capacity
is found by search, each check cutting greedily.

Only DataFrame operations carry data.  Cumulative sizes of all groups are a
table sorted by them.  A greedy check needs, for each shard, the last group end
at or below a bound; the end found answers all candidate capacities of a search
round at once (conditional maxima, one row).  Each step reads only the slice of
the table in which the answers can lie: no group is larger than the largest one,
so the bounds of a step span a known range (a pushed filter on sorted files).
The driver holds one number per candidate and shard, whatever the data.

Slots are row counts before a row: of earlier groups (cumulative), and of equal
texts with smaller doc_id, found by range partitions of (group, doc_id) so that
a group of a third of all rows is numbered in many tasks; the group's shard and
first slot are joined to its pieces, a row per partition, and rows to their piece.

Defined results: null text has size 1 and groups with empty text; null doc_id
sorts first; rows equal in doc_id and text are each placed, in any order of
slots among them; fewer groups than shards leave shards empty; an empty table
gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import common as C

#: Capacities tried in one round of the search (each round divides the range by this).
CANDIDATES = 64
#: Rows of a range partition.
PART_ROWS = 1_000_000


def _running(df: DataFrame, keys: list[str], sums: dict[str, str], rows: int, name: str) -> DataFrame:
    """Adds, for each (column: new column) of ``sums``, its sum over all rows up to each row in order of ``keys``.

    Range partitions are summed, the sums of earlier partitions (a row each) are
    added to the running sums inside a partition: no window spans more than one.
    """
    parts = C.parts_for(df.sparkSession, rows, PART_ROWS)
    d = C.keep(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), f"{name}-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = d.groupBy("_part").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums)).select("_part", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(totals, "_part").select(*df.columns, *((F.col(f"_b_{c}") + F.sum(c).over(inside)).alias(new) for c, new in sums.items()))


def _last_ends(ends: DataFrame, bounds: list[int], largest: int) -> list[int]:
    """For each bound the last group end at or below it (0: none), in one aggregate over a slice."""
    near = ends.filter((F.col("end_bytes") > min(bounds) - largest) & (F.col("end_bytes") <= max(bounds)))
    row = near.agg(*(F.max(F.when(F.col("end_bytes") <= b, F.col("end_bytes"))).alias(f"c{i}") for i, b in enumerate(bounds))).first()
    return [int(x or 0) for x in row]


def minimax_cuts(ends: DataFrame, shards: int, total: int, largest: int) -> list[int]:
    """Ends (in bytes) of the shards of the smallest feasible capacity, by greedy cuts.

    ``ends`` has the cumulative sizes ``end_bytes`` of all groups in order.
    """
    def greedy(capacities: list[int]) -> list[list[int]]:
        cuts: list[list[int]] = [[] for _ in capacities]
        for _ in range(shards):
            at = [c[-1] if c else 0 for c in cuts]
            found = _last_ends(ends, [a + x for a, x in zip(at, capacities, strict=True)], largest)
            for c, a, f in zip(cuts, at, found, strict=True):
                c.append(max(a, f))
        return cuts

    low = max(-(-total // shards), largest)  # no capacity below it is feasible
    high = -(-total // shards) + largest  # always feasible
    while True:
        step = max(1, -(-(high - low) // (CANDIDATES - 1)))
        tried = list(range(low, high, step)) + [high]
        cuts = greedy(tried)
        best = next(i for i, c in enumerate(cuts) if c[-1] >= total)
        if step == 1 or best == 0:
            return cuts[best]
        low, high = tried[best - 1] + 1, tried[best]


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes plus one), text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = C.keep(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), C.id_key().alias("k"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("text_key")), "shard-rows")
    groups = rows.groupBy("text_key").agg(F.min("k").alias("first_k"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    n, total, largest = (int(x or 0) for x in groups.agg(F.count(F.lit(1)), F.sum("bytes"), F.max("bytes")).first())
    ends = C.keep(_running(groups, ["first_k", "text_key"], {"bytes": "end_bytes", "rows": "end_rows"}, n, "shard-groups").sortWithinPartitions("end_bytes"), "shard-ends")
    cuts = minimax_cuts(ends, shards, total, largest) if n else []
    number = F.lit(0)
    for c in cuts[:-1]:
        number = number + (F.col("end_bytes") > c).cast("int")
    placed = ends.select("text_key", (F.col("end_rows") - F.col("rows")).alias("before"), number.alias("shard"))
    firsts = placed.groupBy("shard").agg(F.min("before").alias("shard_before"))  # a row per shard
    placed = placed.join(F.broadcast(firsts), "shard")

    n_rows = C.parts_for(docs.sparkSession, rows.count(), PART_ROWS)
    ranged = C.keep(rows.repartitionByRange(n_rows, "text_key", "k").withColumn("_part", F.spark_partition_id()), "shard-ranked")
    piece = Window.partitionBy("text_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # pieces of a group: one per partition
    pieces = ranged.groupBy("text_key", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_earlier", F.coalesce(F.sum("_n").over(piece), F.lit(0))).drop("_n")
    # shard and slot of each piece's first row; rows meet them by piece, so a hot text is in many tasks
    starts = pieces.join(placed, "text_key").select("text_key", "_part", "shard", (F.col("before") - F.col("shard_before") + F.col("_earlier")).alias("_start"))
    within = Window.partitionBy("text_key", "_part").orderBy("k")
    ranked = ranged.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(starts, ["text_key", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_start") + F.col("_rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
