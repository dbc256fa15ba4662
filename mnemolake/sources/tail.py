"""Lines appended to log files, as a stream with byte offsets.

A Python streaming data source over a folder that the driver and all executors mount. An offset holds, per file number,
how far the file is read and a checksum of its first bytes. A batch goes on from there to the last line end; a line still
being written waits. Files are known by their number, so one that is renamed by rotation is not read again; a file that
has become shorter, or whose head has changed, is a new one and read from its start. Partitions are ranges of bytes; a
line belongs to the range it starts in, so a long file is many tasks' work. Offsets are all the state there is: over a
restart from the stream's checkpoint each line is read exactly once.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail").load(folder)    # (file, position, value)
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE = 64 << 20
HEAD = 256
STEP = 1 << 20


class _Range(InputPartition):
    def __init__(self, folder: str, number: int, first: int, start: int, stop: int):
        self.folder, self.number = folder, number
        self.first, self.start, self.stop = first, start, stop


def _files(folder: str) -> dict[int, str]:
    """Path by file number; hidden files and what starts with an underscore are left out."""
    with os.scandir(folder) as found:
        return {e.stat().st_ino: e.path for e in found if e.is_file() and e.name[0] not in "._"}


def _head(path: str, n: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(n))


def _last_line_end(path: str, size: int) -> int:
    """Just behind the last line end before ``size``; 0 if there is none."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            low = max(0, at - STEP)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, step: int = RANGE):
        self.folder, self.step = folder, step

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """{file number: [bytes up to the last line end, bytes of the head, their checksum]}"""
        now = {}
        for number, path in _files(self.folder).items():
            stop = _last_line_end(path, os.path.getsize(path))
            n = min(HEAD, stop)
            now[str(number)] = [stop, n, _head(path, n)]
        return now

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        paths = _files(self.folder)
        out = []
        for number, (stop, _, _) in end.items():
            before = start.get(number)
            path = paths.get(int(number))
            goes_on = before and path and before[0] <= stop and _head(path, before[1]) == before[2]
            first = before[0] if goes_on else 0
            out += [_Range(self.folder, int(number), first, at, min(at + self.step, stop)) for at in range(first, stop, self.step)]
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        path = _files(part.folder)[part.number]
        with open(path, "rb") as f:
            f.seek(part.start)
            if part.start > part.first:
                # The line that began in the range before is read there.
                f.seek(part.start - 1)
                f.readline()
            at = f.tell()
            while at < part.stop:
                line = f.readline()
                yield os.path.basename(path), at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


class TailSource(DataSource):
    """Options: the folder as path, and ``range``, the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, position long, value string"

    def streamReader(self, schema) -> TailReader:
        folder = self.options["path"].removeprefix("file://").removeprefix("file:")
        return TailReader(folder, int(self.options.get("range", RANGE)))
