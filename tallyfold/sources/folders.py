"""Names, moves and removals of files through Spark's own file systems: any path that Spark reads."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


class Folder:
    """A folder of a table. Only names pass the driver, never contents."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.root = self._path(path)
        self.system = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def at(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, below: str = "") -> list[str]:
        """What lies directly in the folder."""
        place = self.at(below) if below else self.root
        if not self.system.exists(place):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(place))

    def files(self, below: str = "") -> list[str]:
        """The files below, by their path from there; hidden ones are left out."""
        out = []
        for name in self.names(below):
            inside = f"{below}/{name}" if below else name
            if name[0] in "._":
                continue
            if self.system.getFileStatus(self.at(inside)).isDirectory():
                out += [f"{name}/{f}" for f in self.files(inside)]
            else:
                out.append(name)
        return out

    def exists(self, name: str) -> bool:
        return self.system.exists(self.at(name))

    def remove(self, name: str) -> None:
        self.system.delete(self.at(name), True)

    def move(self, name: str, to: str) -> None:
        self.system.mkdirs(self.at(to).getParent())
        if not self.system.rename(self.at(name), self.at(to)) and not self.exists(to):
            raise OSError(f"{name} could not be moved to {to}")

    def put(self, name: str, text: str) -> None:
        """Write a small file as a whole: it is there with all of its text, or not there."""
        draft = f"{name}.draft"
        stream = self.system.create(self.at(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.move(draft, name)

    def get(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
