"""The few file-system calls we need, through Hadoop's interface: any scheme that Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.gateway = spark.sparkContext._gateway
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: written aside and renamed over."""
        scratch = f"{path}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(scratch), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        option = self.gateway.new_array(rename, 1)
        option[0] = rename.OVERWRITE
        context.rename(self.path(scratch), self.path(path), option)

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def modified(self, path: str) -> float:
        """Seconds since 1970."""
        return self.fs.getFileStatus(self.path(path)).getModificationTime() / 1000

    def empty(self, root: str) -> list[str]:
        """Paths, without the scheme, of the files of no bytes below ``root``."""
        found, listing = [], self.fs.listFiles(self.path(root), True)
        while listing.hasNext():
            status = listing.next()
            if status.getLen() == 0:
                found.append(status.getPath().toUri().getPath())
        return found

    def children(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path))) if self.exists(path) else []


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor can't change it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; our own where it is unset in local mode (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster sees")
    if not named:
        named = getattr(spark.sparkContext, "_tessera_core", None)
        if not named:
            named = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext._tessera_core = named
    return named
