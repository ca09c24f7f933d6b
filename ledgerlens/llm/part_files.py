"""Files written and read inside tasks on the storage that all executors share.

A task opens its own file (the name carries the attempt), and the manifest, one
row per finished task, is what counts: files of lost or repeated attempts are in
no manifest.  The driver names the folder by its whole URI first, as Spark
itself resolves a path without scheme; ``pyarrow.fs`` opens it (file, hdfs, s3, gs).
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's URI; without a scheme it lies in Spark's default file system, not on each executor's disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


def writer(folder: str, suffix: str):
    """(partition number, path, output stream) for the running task."""
    part = TaskContext.get().partitionId()
    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}{suffix}"
    fs, name = _open(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return part, path, fs.open_output_stream(name, compression=None)


def read(path: str) -> bytes:
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        return f.read()


def spread(manifest: DataFrame, files: int) -> DataFrame:
    """One file per task."""
    return manifest.repartitionByRange(max(1, files), "part")


def opened(path: str):
    """The file as a seekable input stream."""
    fs, name = _open(path)
    return fs.open_input_file(name)
