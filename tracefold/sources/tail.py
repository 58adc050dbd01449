"""A streaming source that follows a growing log of lines and its rotated predecessors; executors read the bytes.

An offset holds, for each file of the log, how many bytes of whole lines there are. Files are told apart by inode and a hash of their first line, not by name:

* a file that is renamed (log, log.1, log.2, ...) goes on under its own entry, and what it got before it was renamed is still read;
* a new file under the old name has an entry of its own, from byte 0;
* a file that is truncated and written anew has another first line and so another entry, also if it has grown past its old length.

Offsets tell what there is now and nothing about what was read, so a restarted query finds its place in its checkpoint. A batch is the ranges between two
offsets, cut into partitions of about `partitionBytes`: a line belongs to the partition that its first byte is in, so partitions need no
agreement. The driver looks at the first line and at the end of each file only.

A line that is still being written waits. Rotated files that end without a line break count as whole once they are `settleSeconds` old. Compressed files are
left out. A file that is gone before its bytes were read is an error, unless `failOnDataLoss` is false. The folder must be one that driver and executors share.
"""

from __future__ import annotations

import glob
import hashlib
import os
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PARTITION_BYTES = 1 << 25
BLOCK = 1 << 16
ROWS = 8192  # lines in an Arrow batch, or about BATCH_BYTES of them
BATCH_BYTES = 1 << 22
COMPRESSED = (".gz", ".bz2", ".zst", ".xz", ".zip", ".7z")


@dataclass
class Bytes(InputPartition):
    """The lines of a file that begin in [start, end); `begin` is where the batch begins, at the start of a line."""

    file: str
    begin: int
    start: int
    end: int


def _identity(path: str) -> str | None:
    """Inode and a hash of the first line; None while the file has no whole line."""
    with open(path, "rb") as file:
        digest, inode = hashlib.sha256(), os.fstat(file.fileno()).st_ino
        while block := file.read(BLOCK):
            end = block.find(b"\n")
            digest.update(block[: end + 1] if end >= 0 else block)
            if end >= 0:
                return f"{inode}-{digest.hexdigest()[:16]}"
    return None


def _whole(path: str) -> int:
    """The bytes up to the last line break."""
    with open(path, "rb") as file:
        end = file.seek(0, os.SEEK_END)
        while end > 0:
            start = max(0, end - BLOCK)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def files(path: str) -> dict[str, str]:
    """Names by identity: the log and what stands beside it as log.*, without compressed files."""
    out = {}
    for name in [path, *sorted(glob.glob(glob.escape(path) + ".*"))]:
        try:
            if not name.endswith(COMPRESSED) and os.path.isfile(name) and (key := _identity(name)):
                out.setdefault(key, name)
        except FileNotFoundError:  # renamed meanwhile; it has another name or the next look finds it
            continue
    return out


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, partition_bytes: int, settle: float, strict: bool):
        self.path, self.size, self.settle, self.strict = path, partition_bytes, settle, strict

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for key, name in files(self.path).items():
            try:
                state = os.stat(name)
                settled = name != self.path and time.time() - state.st_mtime >= self.settle
                out[key] = state.st_size if settled else _whole(name)
            except FileNotFoundError:
                continue
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for key, upto in end.items():
            begin = start.get(key, 0)
            out += [Bytes(key, begin, at, min(at + self.size, upto)) for at in range(begin, upto, self.size)]
        return out

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        name = files(self.path).get(partition.file)
        if name is None:
            if self.strict:
                raise FileNotFoundError(f"{self.path}: a rotated file is gone before it was read")
            return
        lines, size = [], 0
        with open(name, "rb") as file:
            at = partition.start
            if at > partition.begin:
                file.seek(at - 1)
                at += len(file.readline()) - 1
            else:
                file.seek(at)
            while at < partition.end and (line := file.readline()):
                at += len(line)
                if text := line.strip():
                    lines.append(text.decode("utf-8", "replace"))
                    size += len(text)
                if len(lines) >= ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                    lines, size = [], 0
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    """format("tail").option("path", ...), and partitionBytes, settleSeconds, failOnDataLoss"""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> TailReader:
        o = self.options
        return TailReader(o["path"], int(o.get("partitionBytes", PARTITION_BYTES)), float(o.get("settleSeconds", 10)), str(o.get("failOnDataLoss", "true")).lower() != "false")
