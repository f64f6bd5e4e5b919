"""Small files in any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def mkdirs(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces a file as a whole: written beside it, then renamed over it."""
        side = self._path(f".{name}.new")
        out = self.fs.create(side, True)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(side, self._path(name), options)

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name)))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
