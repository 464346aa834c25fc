"""Copying files between file systems, with a filter by extension."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession

#: Threads that stream files between remote file systems, and tasks that copy mounted ones, at most.
COPIES_AT_ONCE, MOST_TASKS = 16, 1000


def copy_files(spark: SparkSession, source: str, destination: str, extensions: Sequence[str] = (), recursive: bool = True) -> list[str]:
    """Copy a file, or the files below a folder, keeping their places; returns the destinations in order.

    Works between any Hadoop file systems (local, gs://, s3a:// and so on, with the connector and its credentials in
    the session). extensions: with or without the dot; all if empty. A missing source raises FileNotFoundError, a folder without a match copies
    nothing. Existing files are overwritten. The driver lists the files; where both folders are mounted on the executors
    (file paths), the copies are dealt over the tasks by size, else COPIES_AT_ONCE threads of the driver stream them.
    """
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(destination)
    fs, out = src.getFileSystem(conf), dst.getFileSystem(conf)
    if not fs.exists(src):
        raise FileNotFoundError(source)
    wanted = tuple("." + e.lstrip(".").lower() for e in extensions)
    root = fs.makeQualified(src)
    single = fs.getFileStatus(src).isFile()
    found, files = [], fs.listFiles(src, recursive)
    while files.hasNext():
        path = files.next().getPath()
        if not wanted or path.getName().lower().endswith(wanted):
            place = path.getName() if single else root.toUri().relativize(path.toUri()).getPath()
            if not single and place.startswith("/"):
                place = path.toString()[len(root.toString().rstrip("/")) + 1 :]
            found.append((path, place))
    found.sort(key=lambda x: x[1])
    targets = [jvm.org.apache.hadoop.fs.Path(dst, place) for _, place in found]
    if found and fs.getScheme() == out.getScheme() == "file":
        names = [(p.toUri().getPath(), out.makeQualified(t).toUri().getPath()) for (p, _), t in zip(found, targets, strict=True)]
        spark.createDataFrame(names, "a string, b string").repartition(min(len(names), MOST_TASKS), "b").mapInPandas(_copy_mounted, "b string").write.format("noop").mode("overwrite").save()
    else:
        copy = lambda k: jvm.org.apache.hadoop.fs.FileUtil.copy(fs, found[k][0], out, targets[k], False, True, conf)
        with ThreadPoolExecutor(COPIES_AT_ONCE) as pool:
            list(pool.map(copy, range(len(found))))
    return [t.toString() for t in targets]


def _copy_mounted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copy files a to b; under another name first, so a task that runs again leaves no half file."""
    for batch in batches:
        for a, b in zip(batch["a"], batch["b"], strict=True):
            target = Path(b)
            target.parent.mkdir(parents=True, exist_ok=True)
            part = target.with_name(f".{target.name}.{os.getpid()}")
            shutil.copyfile(a, part)
            part.replace(target)
        yield batch[["b"]]
