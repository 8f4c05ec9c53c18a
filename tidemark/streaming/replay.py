"""A finite table as the source of a stream that comes in order of event time."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


def staged(df: DataFrame, at: str, slices: int, last: DataFrame, base: str) -> str:
    """The folder of a source that a stream reads one file at a time (maxFilesPerTrigger 1): df in slices of `at`, then last.

    One job cuts df into `slices` files by range, so no row of a file is older than those of the file before; rows of one
    instant stay together. `last` is written as one file behind them, to move watermarks past every horizon.
    """
    df.repartitionByRange(max(1, slices), at).write.parquet(f"{base}/staged")
    last.coalesce(1).write.parquet(f"{base}/last")
    in_order(df.sparkSession, [f"{base}/staged", f"{base}/last"], f"{base}/source")
    return f"{base}/source"


def in_order(spark: SparkSession, folders: list[str], source: str) -> None:
    """Move the files of folders, in order of folders and names, to source, each newer than the one before.

    A stream reads files by their time of change. Stores that keep the time of a moved file let it be set, others give a new one.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(conf)
    fs.mkdirs(path(source))
    found = [(folder, sorted(f.getPath().getName() for f in fs.listStatus(path(folder)))) for folder in folders]
    names = [(folder, n) for folder, files in found for n in files if n.endswith(".parquet")]
    begin, last = int(time.time()) - len(names) - 10, -1
    for i, (folder, name) in enumerate(names):
        target = path(f"{source}/{i:06}.parquet")
        if not fs.rename(path(f"{folder}/{name}"), target):
            raise OSError(f"cannot move {folder}/{name}")
        fs.setTimes(target, (begin + i) * 1000, -1)
        changed = fs.getFileStatus(target).getModificationTime()
        while changed <= last:  # a store with times of its own that are too coarse: copy until they differ
            time.sleep(1)
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, target, fs, path(f"{source}/_{i:06}"), True, conf)
            fs.rename(path(f"{source}/_{i:06}"), target)
            changed = fs.getFileStatus(target).getModificationTime()
        last = changed
