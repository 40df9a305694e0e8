"""Folders and marker files on whatever file system Spark writes to (driver-side names only, no data)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Folder:
    """A path, a folder or a file, reached through Spark's file system layer."""

    spark: SparkSession
    path: str

    def _at(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def exists(self) -> bool:
        fs, at = self._at()
        return fs.exists(at)

    def names(self) -> list[str]:
        """Names inside the folder (none if it does not exist)."""
        fs, at = self._at()
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def state(self) -> tuple:
        """Names, sizes and times of the files at or below the path (two levels), to tell whether a table has changed."""
        fs, at = self._at()
        out = []
        for s in fs.listStatus(at):
            for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s]):
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return tuple(sorted(out))

    def make(self) -> None:
        fs, at = self._at()
        fs.mkdirs(at)

    def touch(self) -> None:
        """An empty marker file (replacing one that is there)."""
        fs, at = self._at()
        fs.create(at, True).close()

    def put(self, text: str) -> None:
        """Write a small text file whole: beside its place, then renamed onto it."""
        fs, at = self._at()
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(at):
            fs.delete(at, False)
        fs.rename(draft, at)

    def text(self) -> str:
        fs, at = self._at()
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def remove(self) -> None:
        fs, at = self._at()
        fs.delete(at, True)
