"""Files through the Hadoop file system, so that local paths, HDFS and object stores behave alike."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Operations on paths or URIs, by the session's Hadoop configuration."""

    def __init__(self, spark: SparkSession) -> None:
        self.path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.path_of(str(path))
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def listed(self, path: str) -> list[str]:
        """Names in a folder."""
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where))

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def move(self, source: str, target: str) -> None:
        """Rename a file or folder; an earlier target is replaced."""
        fs, where = self._at(source)
        _, to = self._at(target)
        fs.mkdirs(to.getParent())
        fs.delete(to, True)
        if not fs.rename(where, to):
            raise OSError(f"{source} could not be moved to {target}")


def arrow_filesystem(uri: str):
    """(pyarrow file system, path in it): what executors open files with."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")
