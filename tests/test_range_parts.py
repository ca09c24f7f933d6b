"""Range partitions of the mutual information grow in number with the rows, not in size."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import selection as sel


@pytest.mark.parametrize("by_neighbours", [True, False])
def test_more_rows_make_more_parts_and_the_same_information(spark, monkeypatch, by_neighbours):
    df = spark.range(600).select(F.lit("t").alias("tenant_id"), "id", (F.col("id") % 3).cast("string").alias("y"),
                                 F.when(F.col("id") % 50 != 0, (F.col("id") * 7 % 90 + F.col("id") % 3 * 40).cast("double")).alias("a"))
    how = {"id_col": "id"} if by_neighbours else {}
    few = sel.mutual_information(df, ["tenant_id"], "y", numeric=["a"], **how).collect()
    seen, plain = [], sel._range_parts
    monkeypatch.setattr(sel, "RANGE_ROWS", 20)
    monkeypatch.setattr(sel, "_range_parts", lambda t: seen.append(plain(t)) or seen[-1])
    assert sel.mutual_information(df, ["tenant_id"], "y", numeric=["a"], **how).collect() == few
    assert few[0].mi > 0 and min(seen) > 4


def test_running_counts_over_parts(spark, monkeypatch):
    monkeypatch.setattr(sel, "RANGE_ROWS", 10)
    df = spark.range(100).select((F.col("id") % 2).alias("g"), (F.col("id") % 20).alias("v"), F.lit(1).alias("_n"))
    for r in sel._running(df, ["g"], ["v"], "test_running", 10).collect():
        assert (r["_below"], r["_to"]) == (r["v"] // 2 * 5, r["v"] // 2 * 5 + 5)
