"""Cutting lineage through a table in the cluster's shared folder.

A cut is a Parquet table under ``spark.checkpoint.dir``: it is computed once, survives the loss of any executor and
is read back with column pruning. Only a local session that names no folder (as in tests) gets one of its own; on a cluster that is an error,
since executors could not see it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="skein-cut-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_place(spark: SparkSession, kind: str = "skein") -> str:
    """A folder of its own in the shared one, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, no lineage."""
    spark = df.sparkSession
    path = new_place(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables and folders this process has made. Call it when their results have been written."""
    for path in _made:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _made.clear()
