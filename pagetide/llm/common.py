"""What the corpus operators share: shared-folder tables, Arrow text buffers, id handling."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass holds at a time; a longer single text is one pass of its own.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session takes a fresh folder of its own (tests); a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pagetide-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors. What its plan left on the driver goes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing reads any more, and let Spark drop the shuffle files of plans that are gone."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        if path.startswith(root) or path.startswith(root.replace("file://", "file:")):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    collect_garbage(spark)


def collect_garbage(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files and broadcasts once the driver has collected their plan as garbage; its heap, which grows by plans and task metrics, shrinks too."""
    gc.collect()
    spark._jvm.System.gc()


def repeatable(df: DataFrame) -> bool:
    """Whether every reading gives the same rows in the same partitions: files, and row by row steps of built-in functions over them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    names = set(re.findall(r"^[\s:+\-*]*(?:\(\d+\) )?([A-Z]\w+)", plan, re.M))
    return "FileScan" in names and names <= {"FileScan", "Project", "Filter", "ColumnarToRow", "WholeStageCodegen", "InputAdapter", "AdaptiveSparkPlan"}


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch that Spark hands to Python, which rows alone don't where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of a string array without copies; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    n = len(arr)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if n == 0 or offs is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the text of one column passes `most` bytes, so that memory doesn't follow the batch size."""
    off, _ = string_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, found without regard to clashing extra columns."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fresh(taken, name: str) -> str:
    """A column name that none of the taken ones equals in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
