"""SparkSession defaults for ledgerlens jobs.

On a cluster the session comes from the platform; ``get_spark`` only adds
settings that are unset.  ``spark.checkpoint.dir`` is read from the session
(shared storage named by the cluster); a local folder is created only in a
single local process that names none, as in tests.
"""

from __future__ import annotations

import os
import re
import tempfile
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

R = TypeVar("R")

# Settings every job relies on (AQE re-plans joins at runtime, splits skewed
# partitions and coalesces small ones; the UI server stays off).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # top-k windows use WindowGroupLimit (partial top-k before the shuffle)
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


_LOCAL_DIRS: dict[str, str] = {}


def get_spark(app: str = "ledgerlens", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """The running session with the defaults it leaves unset, or a new one with all of them."""
    running = SparkSession.getActiveSession()
    if running is not None:
        own = running.sparkContext.getConf()
        for k, v in _DEFAULTS.items():
            if k.startswith("spark.sql.") and not own.contains(k):
                running.conf.set(k, v)
        ensure_checkpoint_dir(running)
        return running
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Without either, one local process (master ``local`` or ``local[n]``) gets a temporary
    folder; on a cluster that is an error, since executors do not share local folders.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or _LOCAL_DIRS.get(sc.applicationId)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one written table, under the folder of this application."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean_scratch(spark: SparkSession) -> None:
    """Deletes what this application wrote through ``scratch_path``; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark deletes the shuffle files of a query when it has ended, not when the driver happens to collect its garbage.
_END_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ENDING: dict[int, tuple[int, str | None]] = {}
_ENDING_LOCK = threading.Lock()


@contextmanager
def _ending_shuffles(spark: SparkSession):
    """Sets ``_END_SHUFFLES`` as long as any thread is in here, then what the session had."""
    with _ENDING_LOCK:
        n, before = _ENDING.get(id(spark), (0, None))
        if not n:
            before = spark.conf.get(_END_SHUFFLES, None)
            spark.conf.set(_END_SHUFFLES, "true")
        _ENDING[id(spark)] = (n + 1, before)
    try:
        yield
    finally:
        with _ENDING_LOCK:
            n, before = _ENDING.pop(id(spark))
            if n > 1:
                _ENDING[id(spark)] = (n - 1, before)
            elif before is None:
                spark.conf.unset(_END_SHUFFLES)
            else:
                spark.conf.set(_END_SHUFFLES, before)


def side_by_side(calls: list[Callable[[], R]]) -> list[R]:
    """The results of the calls, three at a time in threads; small stages of one fill what the others leave idle.

    More would need the driver's memory and the disk for more plans and shuffles at once.  The first call that
    fails raises when all have ended.
    """
    with ThreadPoolExecutor(3) as pool:
        return [x.result() for x in [pool.submit(call) for call in calls]]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts lineage (a lost executor recomputes from the written files, not from
    the sources) and gives AQE exact sizes for the next joins.  The folder is
    the cluster's shared checkpoint location, never a machine-local one.  Nothing reads the shuffles
    of the write again, so they go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    t0 = time.time()
    with _ending_shuffles(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if os.environ.get("LEDGERLENS_TRACE"):
        print(f"[materialize] {name}: {time.time() - t0:.2f}s", flush=True)
    out = spark.read.parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``df``; only for a table that no result reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
