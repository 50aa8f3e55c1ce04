"""A streaming source that tails growing session files by byte offsets, read by the executors.

spark.dataSource.register(SessionTail); spark.readStream.format("session_tail").option("dirs", "/a,/b").option("positions", "/p").load()
gives (path, value). Files *.jsonl that have been quiet for a while are read from where the last poll ended up to their last complete line; a file
that has become shorter is read from its beginning. The driver lists the folders and looks for ends of lines alone; the ranges of bytes between two
offsets are dealt out as input partitions, so dirs must be seen by all executors. The engine's checkpoint commits the offsets. `positions` names
a file next to it, which the driver replaces before it hands out an offset: after a restart a poll goes on from there, while the
engine begins where its last committed batch ended, so nothing is lost or read twice.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Seconds for which a file must not have changed, and observations taken at one poll, of all files together.
QUIET, LINES = 30, 20
#: Bytes of an input partition, and bytes that are looked at together for ends of lines.
SPLIT, LOOK = 32 << 20, 1 << 16


class SessionTail(DataSource):
    """Options: dirs (comma-separated), positions (a file), quiet (seconds), start (`end` as the default, or `beginning`), lines (0: any number),
    split (bytes of a partition). An observation is a line, so as many lines at most are taken at a poll; the rest comes with the next polls."""

    @classmethod
    def name(cls) -> str:
        return "session_tail"

    def schema(self) -> str:
        return "path string, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return TailReader(self.options)


@dataclass
class Bytes(InputPartition):
    """The lines of a file that begin in these bytes."""

    path: str
    start: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.dirs = [d.strip() for d in options.get("dirs", "").split(",") if d.strip()]
        if not options.get("positions"):
            raise ValueError("set positions to a file for the offsets handed out")
        self.positions = options["positions"]
        self.quiet, self.split = float(options.get("quiet", QUIET)), int(options.get("split", SPLIT))
        self.lines = int(options.get("lines", LINES))
        self.from_end = options.get("start", "end") == "end"

    def _files(self) -> Iterator[tuple[str, int, float]]:
        for d in self.dirs:
            if os.path.isdir(d):
                for name in sorted(os.listdir(d)):
                    if name.endswith(".jsonl"):
                        path = os.path.realpath(os.path.join(d, name))
                        told = os.stat(path)
                        yield path, told.st_size, time.time() - told.st_mtime

    def _held(self) -> dict:
        """Where the first poll began (base) and the last one ended (at)."""
        if os.path.exists(self.positions):
            with open(self.positions) as f:
                return json.load(f)
        base = {path: size if self.from_end else 0 for path, size, _ in self._files()}
        return self._hold({"base": base, "at": base})

    def _hold(self, held: dict) -> dict:
        with open(f"{self.positions}.new", "w") as f:
            json.dump(held, f)
        os.replace(f"{self.positions}.new", self.positions)
        return held

    def initialOffset(self) -> dict:  # noqa: N802
        return self._held()["base"]

    def latestOffset(self) -> dict:  # noqa: N802
        held = self._held()
        end, left = dict(held["at"]), self.lines
        for path, size, age in self._files():
            at = end.get(path, 0)
            at = 0 if size < at else at
            if age < self.quiet or size == at or (self.lines and not left):
                continue
            if self.lines:
                to, n = _after(path, at, size, left)
                left -= n
            else:
                to = _last(path, at, size)
            if to > at:
                end[path] = to
        if end != held["at"]:
            self._hold({"base": held["base"], "at": end})
        return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, to in sorted(end.items()):
            at = start.get(path, 0)
            at = 0 if to < at else at
            out += [Bytes(path, s, min(to, s + self.split)) for s in range(at, to, self.split)]
        return out

    def read(self, partition: Bytes) -> Iterator[tuple[str, str]]:
        """A file that is gone or shorter now gives what is left of it."""
        if not os.path.exists(partition.path):
            return
        with open(partition.path, "rb") as f:
            if partition.start:
                f.seek(partition.start - 1)
                f.readline()
            while f.tell() < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text.strip():
                    yield partition.path, text


def _after(path: str, at: int, size: int, lines: int) -> tuple[int, int]:
    """Where so many whole lines after `at` end, or the last before `size`, and how many they are; empty ones don't count."""
    n = 0
    with open(path, "rb") as f:
        f.seek(at)
        while n < lines and at < size:
            line = f.readline()
            if not line.endswith(b"\n") or at + len(line) > size:
                break
            at += len(line)
            n += bool(line.strip())
    return at, n


def _last(path: str, at: int, size: int) -> int:
    """Where the last whole line between two offsets ends; `at` if none does."""
    with open(path, "rb") as f:
        for s in range(size, at, -LOOK):
            low = max(at, s - LOOK)
            f.seek(low)
            found = f.read(s - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
    return at
