"""Shared helpers: reading tables, row keys, lineage cuts and batch functions over text columns."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWEST_ID = -(2 ** 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; unset (tests), a folder in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that no executor's loss costs earlier work."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; its size is then known to the planner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return memory that was freed to the system, where the C library can: a driver keeps the peak of a training otherwise."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def give_back_jvm(spark: SparkSession) -> None:
    """The same for the driver's JVM: what planning and compiling freed stays in its C library's pools. A JVM without this command keeps it."""
    gateway = spark.sparkContext._gateway
    java = gateway.jvm.java.lang
    command = gateway.jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    args = gateway.new_array(java.Object, 4)
    for i, value in enumerate((command, "systemTrimNativeHeap", gateway.new_array(java.Object, 0), gateway.new_array(java.String, 0))):
        args[i] = value
    # the server's own class is closed to Py4J, its interface is open
    invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        pass


def sweep(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints of tables that nothing names any more; a driver with memory to spare seldom collects its garbage.

    Both processes of the driver then give back what is free, so that a long row of steps does not add up.
    """
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()
    give_back_jvm(spark)


def order_id(doc_id: str | Column = "doc_id") -> Column:
    """Id used for ordering: a null id stands before all others."""
    return F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(LOWEST_ID)).cast("bigint")


def text_key(text: str | Column = "text") -> Column:
    """64-bit key that tells apart rows which repeat an id; equal for equal texts."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept out of training: CRC-32 of the id as text leaves 2 on division by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a batch function; batches are bounded by Spark's Arrow limits on rows and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def bounded(texts: list[str] | list[bytes], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` characters (or bytes) each; a longer text stands alone."""
    a = size = 0
    for b, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield a, b
            a, size = b, 0
        size += len(text)
    if a < len(texts):
        yield a, len(texts)
