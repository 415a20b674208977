"""Small helpers every operator shares: shared storage and Arrow text batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one with a local master, and an error with any other."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        made = spark.sparkContext.getCheckpointDir()
        if made is None:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemill-"))
            made = spark.sparkContext.getCheckpointDir()
        folder = made
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage so that a lost executor costs no recomputation, and it
    forgets df's partitioning, so that a later join may split a skewed key. The
    files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that stored() gave, once nothing reads them any more."""
    for table in tables:
        files, place = _place(table.sparkSession, table.stored_at)
        files.delete(place, True)


def fold(id_col: str, folds: int) -> Column:
    """The remainder of the CRC-32 of an id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back_memory() -> None:
    """Return freed memory to the system, which a Python worker otherwise keeps from task to task.

    A task's function, with all that it was sent with, lies in a cycle of references and stays until these are collected.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of so many consecutive values each."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values, kind))


class Slice:
    """Consecutive rows of a batch: their texts' UTF-8 bytes end to end, and where each begins."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most_bytes: int = 1 << 20) -> Iterator[Slice]:
    """Cut batches into slices of about most_bytes of text; one text is never cut. Null text counts as empty."""
    for batch in batches:
        give_back_memory()
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary()), b"")
        _, at, data = text.buffers()
        offsets = np.frombuffer(at, np.int64)[text.offset : text.offset + len(text) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        low = 0
        while low < len(text):
            high = int(np.searchsorted(offsets, offsets[low] + most_bytes, "right")) - 1
            high = min(max(high, low + 1), len(text))
            begin, end = offsets[low], offsets[high]
            yield Slice(batch.slice(low, high - low), whole[begin:end], offsets[low : high + 1] - begin)
            low = high
    give_back_memory()
