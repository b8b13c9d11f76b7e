"""Files that tasks write and read themselves, through Arrow's file systems.

The driver qualifies the folder once with Hadoop's default file system, so that
driver, executors and Spark's readers mean the same place.  Names are unique to an
attempt, and only what a finished task reports belongs to a data set: a task that
fails or runs twice leaves files that no manifest names.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a full URI; it is made if missing."""
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(there)
    return full(system.makeQualified(there).toString())


def full(uri: str) -> str:
    """A URI as Arrow reads it: Hadoop leaves a local one without an authority."""
    return re.sub(r"^file:/+", "file:///", uri)


def system_of(uri: str):
    """The Arrow file system of a full URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def fresh_name(stem: str, ending: str) -> str:
    return f"{stem}-{uuid.uuid4().hex}{ending}"
