"""Storage that every executor sees: the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What separates words throughout: space and the ASCII controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_uri(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in local mode where the session names none (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster sees")
    if not named:
        named = getattr(sc, "_tessera_shared", None)
        if not named:
            named = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
            sc._tessera_shared = named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh directory in the shared folder, as a path that tasks open directly.

    The operators that keep their own binary files (memory-mapped tries, wavelet shards) need the
    shared folder to be mounted on every node, so any other scheme than ``file`` is an error.
    """
    uri = urlparse(shared_uri(spark))
    if uri.scheme not in ("", "file"):
        raise ValueError(f"{purpose}: spark.checkpoint.dir must be a mounted path, not {uri.scheme}:")
    path = os.path.join(uri.path, f"{purpose}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of ours that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    shared_uri(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Hands what this worker has freed back to the system. Workers are used again by other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(run: Callable[[Iterator], Iterator], forget: Callable[[], None] = lambda: None) -> Callable[[Iterator], Iterator]:
    """``run``, a task's function over batches, that leaves no tables behind in its worker."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            forget()
            release()

    return whole
