"""Shared-folder tables and bounded bitmaps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pagestrata-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Lists of the paths written since each `intermediates` that is open began.
_open: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: lineage ends here.

    The table stays, for what reads it may run at any later time; `intermediates` removes it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` and the name of a column of longs that tells its rows apart: doc_id, or where
    that is null or repeats anywhere, a number given to each row of a written copy."""
    ids = docs.groupBy("doc_id").count()
    if docs.schema["doc_id"].dataType.typeName() in ("integer", "long") and ids.where("doc_id IS NULL OR count > 1").isEmpty():
        return docs, "doc_id"
    row = f"row_{uuid.uuid4().hex}"
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Removes at its end all tables `written` meanwhile: results must be stored by then."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open[:] = [x for x in _open if x is not paths]
        for path in paths:
            removed(spark, path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of texts of at most that many rows in this session, unless fewer are set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def released(run: Callable) -> Callable:
    """`run` for mapInArrow, after which the reused worker returns freed memory to the system."""

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return end


def bitmap(df: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """2**bits flags as uint64 words; set where some row has that slot.

    The driver gets at most 2**(bits - 6) pairs of integers, whatever the rows.
    """
    rows = (
        df.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("flags"))
        .toPandas()
    )
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[rows["word"].to_numpy(dtype=np.int64)] = rows["flags"].to_numpy(dtype=np.int64).view(np.uint64)
    return words


def in_bitmap(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of the slots (uint64) are set."""
    return (words[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) != 0
