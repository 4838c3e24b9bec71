"""A streaming source that follows growing line files by byte offset.

    spark.dataSource.register(LineTail)
    spark.readStream.format("line_tail").option("path", folder).load()    # path, pos, value

The offset of a batch is, for each file, its inode and the end of its last complete line. A file that was replaced or
that became shorter is read from the start; a line without its line feed waits for the next batch. Files are read
by tasks, one range each; the driver looks at sizes and at the end of what was added.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that a task reads at most, and that are looked at to find the end of the last line.
RANGE, BLOCK = 64 << 20, 1 << 16


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def complete_end(path: str, start: int, size: int) -> int:
    """The offset behind the last line feed in [start, size), or start."""
    with open(path, "rb") as f:
        at = size
        while at > start:
            low = max(start, at - BLOCK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix

    def _files(self) -> Iterator[str]:
        if os.path.isfile(self.root):
            yield self.root
        for folder, _, names in os.walk(self.root):
            yield from (os.path.join(folder, n) for n in sorted(names) if n.endswith(self.suffix))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        now, before = {}, getattr(self, "_last", {})
        for path in self._files():
            info = os.stat(path)
            inode, start = before.get(path, [info.st_ino, 0])
            if inode != info.st_ino or info.st_size < start:
                start = 0
            now[path] = [info.st_ino, complete_end(path, start, info.st_size)]
        self._last = now
        return {"files": json.dumps(now, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, out = json.loads(start["files"]), []
        for path, (inode, stop) in json.loads(end["files"]).items():
            old, at = before.get(path, [inode, 0])
            at = 0 if old != inode or stop < at else at
            # Ranges end where they like; a line belongs to the range that holds its first byte.
            out += [Range(path, a, min(a + RANGE, stop)) for a in range(at, stop, RANGE)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the rest of a line that began before, or nothing
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                yield partition.path, at, line[:-1].removesuffix(b"\r").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class LineTail(DataSource):
    """Options: path, and suffix of the files (.jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "path string, pos long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"))
