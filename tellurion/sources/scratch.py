"""Where intermediate tables are written.

Lineage is cut by writing Parquet below the folder that the session names in
``spark.checkpoint.dir``: executors and driver both see it, so a lost executor
costs a re-read, not a re-run.  Only a local master (tests, a laptop) may leave the
setting out; it gets a temporary folder of this process.  A cluster without the
setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master without one, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-"))
    return _OWN[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and hand back the written table.

    Every later use reads the same rows, whatever is recomputed after a loss.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
