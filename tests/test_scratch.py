"""What written tables leave behind, and calls side by side."""

from __future__ import annotations

import os
import threading

import pytest

from ledgerlens.session import _END_SHUFFLES, discard, materialize, side_by_side


def _shuffles(spark):
    return set(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keySet().mkString(",").split(","))


def test_a_written_table_keeps_no_shuffle(spark):
    before = _shuffles(spark)
    had = spark.conf.get(_END_SHUFFLES, None)
    kept = spark.range(1000).repartition(3, "id")
    df = materialize(kept.groupBy((kept.id % 7).alias("g")).count(), "scratch_test")
    assert _shuffles(spark) <= before and spark.conf.get(_END_SHUFFLES, None) == had
    assert sorted(r.g for r in df.collect()) == list(range(7))
    path = df._scratch.removeprefix("file:")
    assert all(f.endswith(("zstd.parquet", "_SUCCESS", ".crc")) for f in os.listdir(path))
    discard(df)
    assert not os.path.exists(path)


def test_the_setting_stands_until_the_last_writer_ends(spark):
    had, inside = spark.conf.get(_END_SHUFFLES, None), threading.Barrier(2, timeout=60)

    def call(i):
        inside.wait()  # both at once
        return materialize(spark.range(i + 1), "scratch_side").count()

    assert side_by_side([lambda: call(1), lambda: call(2)]) == [2, 3]
    assert spark.conf.get(_END_SHUFFLES, None) == had
    with pytest.raises(ZeroDivisionError):
        side_by_side([lambda: 1 // 0, lambda: 1])
