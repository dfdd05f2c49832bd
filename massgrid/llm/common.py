"""Where intermediate tables go, and small helpers that every operator shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
import warnings
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massgrid.llm import bytesops

CHECKPOINT_KEY = "spark.checkpoint.dir"


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="massgrid-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the store that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset, as in tests on one
    machine, a temporary folder of this process takes its place.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
    base = base or _own_folder()
    return f"{base.rstrip('/')}/massgrid/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors.

    folder: a shared folder of tables that are removed together.
    """
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}.parquet" if folder else f"{shared_folder(df.sparkSession, name)}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(folder: str) -> None:
    """Delete a folder of tables that no result reads any more. Where pyarrow cannot reach the store they stay, with a warning."""
    try:
        store, path = pafs.FileSystem.from_uri(folder)
        if store.get_file_info(path).type != pafs.FileType.NotFound:
            store.delete_dir(path)
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        warnings.warn(f"{folder} stays: {e}", stacklevel=2)


def text_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) only, so that further columns with any names never collide; a null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of a table; needs no job, and works for any store."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, each: int, least: int = 64, most: int = 1 << 20) -> int:
    """Power of two of hash buckets, so that a bucket holds about `each` bytes of input whatever the input's size."""
    wanted = max(least, min(most, input_bytes(df) // each))
    return 1 << (wanted - 1).bit_length()


def trimmed() -> None:
    """Give free memory of this process back to the system; Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that trims its worker's memory now and then, and when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        for i, out in enumerate(run(batches)):
            yield out
            if i % 8 == 7:
                trimmed()
        bytesops.forget_powers()
        trimmed()

    return wrapped


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more, before the next step needs the disk."""
    for _ in range(2):  # handles of Python first, then what they kept alive
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
