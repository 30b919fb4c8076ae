"""Small files on the file system that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class SharedFiles:
    """Text files, renames and removals through the file system API of the session, so any scheme it knows will do."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = self._path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def at(self, *names: str) -> str:
        return "/".join([self.root.rstrip("/"), *names])

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def read(self, path: str) -> str | None:
        """The text of a file, or None where there is none."""
        if not self.exists(path):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write a file in one step: readers see the old text or the new one."""
        temporary = self._path(f"{path}.{uuid.uuid4().hex}.new")
        stream = self._fs.create(temporary)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        how[0] = options.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf).rename(temporary, self._path(path), how)

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def names(self, path: str, suffix: str = "") -> list[str]:
        """Names in a folder, sorted; none where there is no folder."""
        if not self.exists(path):
            return []
        return sorted(n for s in self._fs.listStatus(self._path(path)) if (n := s.getPath().getName()).endswith(suffix))
