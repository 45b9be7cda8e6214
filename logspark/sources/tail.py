"""A streaming source of text lines that tells where each stands: its file and the byte it begins at.

Files of a folder are followed as they come and as they grow. What a batch reads is a range of bytes of each file, cut
into pieces at lines, so a batch that runs again reads the same lines with the same places, and equal lines of one
file stay apart. Files are read by Arrow's file systems: local and mounted folders, HDFS, S3, GCS.
"""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file string, place bigint, modified timestamp"
PIECE_BYTES = 64 << 20
_BLOCK, _ROWS = 1 << 20, 8192


@dataclass
class Piece(InputPartition):
    """The lines that begin from byte `first` on and before `upto`, of a file range that begins at a line, `start`, and ends at `end`."""

    file: str
    start: int
    first: int
    upto: int
    end: int
    modified: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def lines_of(stream: BinaryIO, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(place, line) without line ends; the last line of a range may lack its own."""
    at = piece.first
    if at > piece.start:  # the line across the edge is the piece before's
        stream.seek(at - 1)
        at -= 1
        while at < piece.end:
            block = stream.read(min(_BLOCK, piece.end - at))
            if (n := block.find(b"\n")) >= 0:
                at += n + 1
                break
            at += len(block)
            if not block:
                return
    stream.seek(at)
    rest, read = b"", at
    while at < piece.upto and at < piece.end:
        block = stream.read(min(_BLOCK, piece.end - read))
        read += len(block)
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for line in parts:
            if at >= piece.upto:
                return
            yield at, line
            at += len(line) + 1
        if not block or read >= piece.end:
            if rest and at < piece.upto:
                yield at, rest
            return


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], options.get("names", "*")
        self.piece_bytes, self.settle = int(options.get("pieceBytes", PIECE_BYTES)), float(options.get("settle", 0))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """How far each file can be read: whole, or while it may still grow up to its last line end."""
        store, root = _opened(self.path)
        found = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern) and info.base_name[0] not in "._":
                grows = self.settle and time.time() - info.mtime.timestamp() < self.settle
                if end := _last_line_end(store, info.path, info.size) if grows else info.size:
                    found[info.path] = end
        return found

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        store, _ = _opened(self.path)
        grown = [(f, start.get(f, 0), upto) for f, upto in sorted(end.items()) if upto != start.get(f, 0)]
        infos = {i.path: i for i in store.get_file_info([f for f, _, _ in grown])} if grown else {}
        out = []
        for f, a, b in grown:
            a = a if a < b else 0  # a file that shrank is another one
            modified = int(infos[f].mtime.timestamp() * 1_000_000) if infos[f].mtime else 0
            out += [Piece(f, a, p, min(p + self.piece_bytes, b), b, modified) for p in range(a, b, self.piece_bytes)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        with store.open_input_file(partition.file) as stream:
            rows: list[tuple[int, bytes]] = []
            for row in lines_of(stream, partition):
                rows.append(row)
                if len(rows) == _ROWS:
                    yield _batch(rows, partition)
                    rows = []
            if rows:
                yield _batch(rows, partition)


def _batch(rows: list[tuple[int, bytes]], piece: Piece) -> pa.RecordBatch:
    n = len(rows)
    return pa.record_batch({
        "value": pa.array([line.decode("utf-8", "replace") for _, line in rows]), "file": pa.array([piece.file] * n), "place": pa.array([at for at, _ in rows], pa.int64()),
        "modified": pa.array([piece.modified] * n, pa.timestamp("us", "UTC")),
    })


def _last_line_end(store: fs.FileSystem, path: str, size: int) -> int:
    """The byte after the last line end of a file, 0 if there is none."""
    with store.open_input_file(path) as stream:
        for end in range(size, 0, -_BLOCK):
            first = max(0, end - _BLOCK)
            stream.seek(first)
            if (n := stream.read(end - first).rfind(b"\n")) >= 0:
                return first + n + 1
    return 0


class LineSource(DataSource):
    """spark.readStream.format("lines").load(folder). Options: names, a pattern of file names; settle, the seconds after its last
    change from which on a file counts as finished, so that a last line without an end is read too (0: at once); pieceBytes."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)
