"""Following text files that grow: a streaming source whose position is a byte offset for every file.

Spark's own file source takes each file once, as it is when first seen. Here the position of a query is, for each
file, the byte behind the last whole line read; the query's checkpoint keeps it, as a tail agent's position file
does. A line that is still being written waits until its line break is there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# The source travels to the workers by value, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "growing_text"
SCHEMA = "value string, path string, position long"
BLOCK = 4 << 20


def open_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, S3, GCS) and the path in it."""
    return fs.FileSystem.from_uri(uri)


def grown_files(uri: str, pattern: str = "*") -> dict[str, int]:
    """The sizes of the files below a folder whose names fit the pattern; hidden ones are passed over."""
    system, path = open_system(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
    files = (f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")
    return {f.path: f.size for f in sorted(files, key=lambda f: f.path) if fnmatch(f.base_name, pattern)}


def last_line_end(system: fs.FileSystem, path: str, low: int, high: int) -> int:
    """The byte behind the last line break between ``low`` and ``high``; ``low`` if there is none."""
    with system.open_input_file(path) as file:
        while high > low:
            start = max(low, high - BLOCK)
            file.seek(start)
            at = file.read(high - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            high = start
    return low


def next_line_start(file: Any, at: int, end: int) -> int:
    """The start of the first line that begins behind byte ``at``."""
    while at < end:
        file.seek(at)
        found = file.read(min(BLOCK, end - at)).find(b"\n")
        if found >= 0:
            return at + found + 1
        at += BLOCK
    return end


@dataclass
class Stretch(InputPartition):
    """Bytes ``start`` to ``stop`` of a file; whoever has a line's first byte reads the line. Nothing lies outside ``low``, ``high``."""

    path: str
    low: int
    high: int
    start: int
    stop: int


class GrowingReader(DataSourceStreamReader):
    def __init__(self, uri: str, pattern: str, split: int) -> None:
        self.uri, self.pattern, self.split = uri, pattern, split
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of the last whole line of every file."""
        system, _ = open_system(self.uri)
        ends = {}
        for path, size in grown_files(self.uri, self.pattern).items():
            before, end = self.seen.get(path, (0, 0))
            if size < before:  # a new file in the place of an old one
                end = 0
            if size != before:
                end = last_line_end(system, path, end, size)
            ends[path] = end
            self.seen[path] = (size, end)
        return ends

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for path, high in end.items():
            low = start.get(path, 0)
            if high < low:  # it has become shorter: a file of its own
                low = 0
            cuts = [*range(low, high, self.split), high]
            out += [Stretch(path, low, high, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = open_system(self.uri)
        part: Any = partition
        with system.open_input_file(part.path) as file:
            at = part.start if part.start == part.low else next_line_start(file, part.start - 1, part.high)
            stop = part.stop if part.stop == part.high else next_line_start(file, part.stop - 1, part.high)
            left = b""
            while at < stop:
                file.seek(at + len(left))
                block = left + file.read(min(BLOCK, stop - at - len(left)))
                whole = block.rfind(b"\n") + 1
                left = block[whole:]
                if not whole:
                    if at + len(left) >= stop:
                        raise OSError(f"{part.path} has changed: no line ends at byte {stop}")
                    continue
                lines = block[: whole - 1].split(b"\n")
                places = [at]
                for line in lines[:-1]:
                    places.append(places[-1] + len(line) + 1)
                values = pa.array([x.decode("utf-8", "replace") for x in lines])
                columns = [values, pa.array([part.path] * len(lines)), pa.array(places)]
                yield pa.RecordBatch.from_arrays(columns, names=["value", "path", "position"])
                at += whole


class GrowingText(DataSource):
    """``format("growing_text")`` with the options ``path``, ``pattern`` and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> GrowingReader:
        given = self.options
        return GrowingReader(given["path"], given.get("pattern", "*"), int(given.get("splitBytes", 64 << 20)))


def tail_growing(spark: SparkSession, folder: str, pattern: str = "*", split_bytes: int = 64 << 20) -> DataFrame:
    """Lines that appear in the files below ``folder``, each once: ``value, path, position`` (the line's first byte).

    New files are found, hidden ones passed over. What has been added since the last batch is read in stretches of
    ``split_bytes`` by as many tasks, so one fast file does not hold up the rest. Lines end with ``\\n``; a CR before it
    stays, bytes that are no UTF-8 are replaced. A file that has become shorter is read from its start again. Compressed
    files cannot be followed. Position and work of a batch grow with the number of files and with what was added, not with
    what was read before. The folder must be on a file system that Arrow reaches from the workers.
    """
    spark.dataSource.register(GrowingText)
    reader = spark.readStream.format(FORMAT).option("path", folder).option("pattern", pattern)
    return reader.option("splitBytes", split_bytes).load()
