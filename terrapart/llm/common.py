"""What the text operators share: scratch tables, row identity and word rules.

Fixed rules: a *word* is a maximal run of characters other than space and U+0009 to U+000D; a null
text counts as empty wherever a contract does not say otherwise.
"""

from __future__ import annotations

import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAKS = "\t\n\x0b\x0c\r"


#: Scratch tables of this process by application, for drop_scratch.
SCRATCH: dict[str, list[str]] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local session that names none gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='terrapart-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_dir(spark)}/terrapart-{name}-{uuid.uuid4().hex}"
    SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete this application's scratch tables; call it once results that read them have been written. Returns their number."""
    jvm, paths = spark.sparkContext._jvm, SCRATCH.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor only costs a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that are no longer referenced (its cleaner follows the JVM's GC)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return freed memory of this process to the system; the allocators of Arrow and C keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, for mapInArrow, giving back what it has freed when its task ends: a waiting Python worker counts as its executor's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def blocks(total: float, each: float, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a non-null text."""
    return F.array_remove(F.split(F.translate(text, WORD_BREAKS, " " * len(WORD_BREAKS)), " "), "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(texts: list, limit: int = 4_000_000):
    """Index ranges over texts holding about limit characters each; one longer text stands alone."""
    start = held = 0
    for at, text in enumerate(texts):
        size = len(text) if text is not None else 0
        if held and held + size > limit:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
