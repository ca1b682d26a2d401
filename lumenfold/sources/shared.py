"""The folder that the driver and every executor share, and small files in it by Hadoop's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Used only where a session on one machine names no shared folder, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/lumenfold"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Store:
    """The file system of a path, whatever kind Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        """What a folder holds; nothing if it doesn't exist."""
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def create(self, path: str, text: str) -> None:
        """A new file; raises if it exists."""
        out = self._fs.create(self._path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
