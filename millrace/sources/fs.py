"""Files on whatever file system a path names (local, HDFS, object stores), through Hadoop's own client."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Files:
    """Paths without a scheme are on the session's default file system."""

    def __init__(self, spark: SparkSession):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        p = self.path(name)
        return p, p.getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        p, fs = self._at(name)
        return fs.exists(p)

    def size(self, name: str) -> int:
        p, fs = self._at(name)
        return fs.getFileStatus(p).getLen()

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none if there is no such folder."""
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make(self, folder: str) -> None:
        p, fs = self._at(folder)
        fs.mkdirs(p)

    def drop(self, name: str) -> None:
        p, fs = self._at(name)
        fs.delete(p, True)

    def move(self, name: str, to: str) -> None:
        """Renames a file; what stands under the new name gives way."""
        p, fs = self._at(name)
        q, _ = self._at(to)
        if fs.exists(q):
            fs.delete(q, True)
        if not fs.rename(p, q):
            raise OSError(f"cannot rename {name} to {to}")

    def blocks(self, name: str, size: int) -> Iterator[bytes]:
        p, fs = self._at(name)
        stream = fs.open(p)
        try:
            while block := bytes(stream.readNBytes(size)):
                yield block
        finally:
            stream.close()

    @contextmanager
    def writer(self, name: str):
        """A function that appends bytes to a new file."""
        p, fs = self._at(name)
        out = fs.create(p, True)
        try:
            yield lambda block: out.write(bytearray(block))
        finally:
            out.close()
