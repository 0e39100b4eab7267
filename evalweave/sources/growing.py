"""A stream source of text files that grow: every line arrives once, when its end has.

The offset of the stream holds for each file how many of its bytes have been seen, so a
file that is appended to gives its new lines and nothing else. A line belongs to the
micro-batch in which its line feed lies; what stands behind the last line feed waits. The
new bytes of a file are read in splits by as many tasks, under the same rule.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file STRING, at BIGINT, line STRING"
SPLIT = 64 << 20  # bytes of new text that one task reads at most, but for the end of its last line
BLOCK = 1 << 20  # bytes read at once
OUT = 4 << 20  # bytes of lines in one record batch


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a plain path or a URI."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sizes(folder: str, pattern: str) -> dict[str, int]:
    """Bytes of each file whose name matches, by its path inside the folder. Only listings are read."""
    system, root = opened(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    inside = {posixpath.relpath(i.path, root): i.size for i in found if i.type == fs.FileType.File}
    return {p: n for p, n in sorted(inside.items()) if fnmatch.fnmatch(posixpath.basename(p), pattern)}


def lines_between(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines whose line feed is one of the bytes start to end - 1."""
    at = start
    while at > 0:  # back to where the line that holds byte `start` begins
        lo = max(0, at - BLOCK)
        file.seek(lo)
        cut = file.read(at - lo).rfind(b"\n")
        at = lo + cut + 1
        if cut >= 0:
            break
    file.seek(at)
    rest, place = b"", at
    while at < end:
        block = file.read(min(BLOCK, end - at))
        if not block:
            return
        at += len(block)
        *whole, rest = (rest + block).split(b"\n") if b"\n" in block else (rest + block,)
        for line in whole:
            yield place, line
            place += len(line) + 1


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.pattern = options["path"].rstrip("/"), options.get("pattern", "*")
        self.split = int(options.get("split", SPLIT))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """What files hold now; a file never goes back, not even if it shrinks or is gone."""
        now = sizes(self.folder, self.pattern)
        self.seen = {p: max(self.seen.get(p, 0), now.get(p, 0)) for p in sorted(self.seen.keys() | now.keys())}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = {p: max(self.seen.get(p, 0), n) for p, n in end.items()} | {p: n for p, n in self.seen.items() if p not in end}
        ranges = ((p, start.get(p, 0), n) for p, n in end.items())
        return [_Range(p, lo, min(lo + self.split, n)) for p, first, n in ranges for lo in range(first, n, self.split)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.folder)
        places, lines, size = [], [], 0

        def batch() -> pa.RecordBatch:
            names = pa.array([partition.path] * len(lines), pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(places, pa.int64()), pa.array(lines, pa.string())], names=["file", "at", "line"])

        with system.open_input_file(posixpath.join(root, partition.path)) as file:
            for at, line in lines_between(file, partition.start, partition.end):
                places.append(at)
                lines.append(line.decode("utf-8", "replace"))
                size += len(line)
                if size > OUT:
                    yield batch()
                    places, lines, size = [], [], 0
        if lines:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Options: path (a folder), pattern (of file names), split (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingLinesReader(self.options)


def growing_lines(spark: SparkSession, folder: str, pattern: str = "*", split: int = SPLIT):
    """A streaming DataFrame file, at, line over the files of a folder."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("pattern", pattern).option("split", str(split)).load(folder)
