"""A streaming sink that counts every batch once: files become visible by one commit per batch.

``df.writeStream.format("committed").option("path", ...)``: tasks write their rows to files of their own and
send the names with their commit messages; the batch's commit then lists them in one small file, written
aside and moved into place. A batch that runs again after a failure finds its commit and drops what it
wrote. Readers see listed files only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    name: str | None


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class CommittedWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _open(self.path)
        name, sink = f"{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if sink is None:
                system.create_dir(f"{base}/data", recursive=True)
                sink = pq.ParquetWriter(f"{base}/data/{name}", batch.schema, filesystem=system)
            sink.write_batch(batch)
        if sink is None:
            return Written(None)
        sink.close()
        return Written(name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        system, base = _open(self.path)
        target = f"{base}/commits/{batchId}"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages, batchId)  # this batch was committed before; it ran again
            return
        system.create_dir(f"{base}/commits", recursive=True)
        aside = f"{base}/commits/.{batchId}-{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as out:
            out.write("".join(f"{m.name}\n" for m in messages if m and m.name).encode())
        system.move(aside, target)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        system, base = _open(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{base}/data/{m.name}")


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def streamWriter(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options["path"])


def write_committed(rows: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends a stream's rows below ``path``, each batch once; returns its writer to be started with a trigger."""
    rows.sparkSession.dataSource.register(Committed)
    return rows.writeStream.format(Committed.name()).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches; nothing yet gives an empty table. Files that no commit lists are left out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(p) or not system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")):
        return spark.createDataFrame([], schema)
    names = spark.read.text(f"{path}/commits").select(F.col("value").alias("_name")).where("_name <> ''")
    rows = spark.read.schema(schema).parquet(f"{path}/data")
    return rows.select("*", F.col("_metadata.file_name").alias("_name")).join(names, "_name", "left_semi").drop("_name")
