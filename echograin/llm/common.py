"""What the operators share: the folder for intermediate tables, and small Arrow helpers."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors reach: spark.checkpoint.dir of the session.

    Only where the session names none and runs on one machine, as in tests, is a temporary
    folder made, and then kept in the session's settings; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = "file://" + tempfile.mkdtemp(prefix="echograin-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/echograin/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns what was written.

    The written table cuts the lineage: a lost executor costs no more than the
    tasks that read it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Deletes every table that store() and the file writers left in the shared folder."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/echograin")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)


def open_files(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it; Hadoop's names for object stores are taken too."""
    for known in ("s3a://", "s3n://"):
        if uri.startswith(known):
            uri = "s3://" + uri[len(known) :]
    return fs.FileSystem.from_uri(uri)


def quoted(name: str) -> str:
    """A column's name, whatever its characters, as an expression takes it."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: StructType) -> DataFrame:
    """mapInArrow with columns by place, so that their names may hold any characters, dots too."""
    places = [f"c{i}" for i in range(len(shape))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, places)

    given = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return given.mapInArrow(placed, StructType([StructField(n, f.dataType) for n, f in zip(places, shape)])).toDF(*shape.names)


#: What workers keep from one task to the next: dictionaries that modules put here.
kept: list[dict] = []


def start_bare() -> None:
    """Lets go of what other operators' tasks left in this worker; for kernels that keep nothing themselves."""
    for cache in kept:
        cache.clear()
    give_back()


def give_back() -> None:
    """Hands memory that Arrow and the C library hold on to back to the system, so that idle workers are small."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
