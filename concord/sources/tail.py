"""A stream of the complete lines that growing text files gain: a Python data source with a byte offset per file.

``spark.dataSource.register(LineTail)``, then ``spark.readStream.format("line_tail").option("path", folder).option("suffix", ".jsonl")``.
The stream's offset is a map of file to bytes read, and no other state exists, so a restarted stream goes on where it was.  A file
that became shorter was written anew and is read from its start; the last line waits until its line feed is there, but for
whole parts of ``max_bytes`` of a longer one.  Many new bytes of a file are read by several tasks.  Driver and executors must see
the files under the same path.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a part of an unfinished line, and about as many bytes as one task reads.
MAX_BYTES, SLICE_BYTES = 256 * 1024, 8 << 20


@dataclass
class Slice(InputPartition):
    """The lines of a file that begin in ``start`` to ``end``, none beyond ``stop``; ``first``: a line begins at ``start``."""

    path: str
    start: int
    end: int
    stop: int
    first: bool


def complete_end(path: str, max_bytes: int = MAX_BYTES) -> int:
    """Where the complete lines of a file end: behind its last line feed, or behind the whole parts of a long line after that."""
    size = os.path.getsize(path)
    with open(path, "rb") as file:
        at = size
        while at > 0:
            step = min(at, 1 << 16)
            file.seek(at - step)
            found = file.read(step).rfind(b"\n")
            if found >= 0:
                at = at - step + found + 1
                break
            at -= step
    return at + (size - at) // max_bytes * max_bytes


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.suffix = options["path"], options.get("suffix", "")
        self.max_bytes, self.slice_bytes = int(options.get("max_bytes", MAX_BYTES)), int(options.get("slice_bytes", SLICE_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of the complete lines of each file."""
        out = {}
        for path in sorted(os.path.join(at, name) for at, _, names in os.walk(self.folder) for name in names if name.endswith(self.suffix)):
            with contextlib.suppress(OSError):  # a file may go meanwhile
                out[path] = complete_end(path, self.max_bytes)
        return out

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        found = []
        for path, stop in end.items():
            since = start.get(path, 0)
            since = 0 if stop < since else since  # written anew
            found += [Slice(path, at, min(at + self.slice_bytes, stop), stop, at == since) for at in range(since, stop, self.slice_bytes)]
        return found

    def read(self, partition: Slice) -> Iterator[tuple[str, int, str]]:
        """(path, offset, value) of each line, its line feed removed."""
        with open(partition.path, "rb") as file:
            at = partition.start
            if not partition.first:  # the line that is under way belongs to the slice before, unless it begins here
                file.seek(at - 1)
                at += len(file.readline(partition.stop - at + 1)) - 1
            file.seek(at)
            while at < partition.end:
                line = file.readline(partition.stop - at)
                if not line:
                    break
                for part in [line] if line.endswith(b"\n") else (line[k : k + self.max_bytes] for k in range(0, len(line), self.max_bytes)):
                    yield partition.path, at, part.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                    at += len(part)

    def commit(self, end: dict) -> None:
        """Nothing is held for batches that are over."""


class LineTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "path string, offset bigint, value string"

    def streamReader(self, schema) -> TailReader:  # noqa: N802, ANN001
        return TailReader(self.options)
