"""Intermediate tables in the folder that the driver and all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only a session on one machine (tests, notebooks) that
has none gets a temporary folder; on a cluster that is an error. Tables written here survive the loss of executors, which cached or
locally checkpointed blocks would not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses."""
    return f"{shared_root(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet and reads it back; cuts the lineage like ``checkpoint()`` but columnar."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_shared(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables that no pending plan reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
