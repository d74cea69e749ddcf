"""A batch data source of text records that are split by byte ranges and told by where they stand.

A record begins with a line that matches `start` and lasts to the next such line, so a mark inside a
line never splits one. Files are read in ranges of `splitbytes`; a range has the records that begin in
it, whatever their length. The id of a record is its file's number (files by name) and its offset:
the same in every read of the same files. Paths are what pyarrow.fs opens: local ones and URIs.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Lines are read in pieces of this many bytes at most, so that no line need be held whole.
PIECE = 1 << 16
#: Bytes of text and rows in one Arrow batch.
BATCH_BYTES, BATCH_ROWS = 1 << 22, 8192
#: Offsets take the lower bits of an id, the number of the file the others.
OFFSET_BITS = 40


@dataclass
class ByteRange(InputPartition):
    path: str
    number: int
    begin: int
    end: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files under a folder but hidden ones and markers, by name."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    shown = [f for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[._]", f.path[len(inner.rstrip("/")) :])]
    root = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((root + f.path, f.size) for f in shown)


def _lines(file: io.BufferedReader, begin: int, end: int) -> Iterator[tuple[int, bool, bytes]]:
    """(offset, whether a line begins here, piece) from the first line that begins at `begin` or after;
    nothing if none begins before `end`."""
    at = max(begin - 1, 0)
    file.seek(at)
    fresh = begin == 0
    found = begin == 0
    while piece := file.readline(PIECE):
        found = found or fresh and at >= begin
        if found:
            yield at, fresh, piece
        elif at >= end:
            return
        at += len(piece)
        fresh = piece.endswith(b"\n")


def _records(part: ByteRange, start: bytes) -> Iterator[tuple[int, bool, bytes]]:
    """(record's offset, whether its first line goes on or begins, piece) of the range's records."""
    mark = re.compile(start)
    system, inner = _opened(part.path)
    with system.open_input_file(inner) as raw, io.BufferedReader(raw, 1 << 20) as file:
        offset, heading = None, False
        for at, fresh, piece in _lines(file, part.begin, part.end):
            if fresh and mark.match(piece):
                if at >= part.end:
                    return
                offset, heading = at, True
            elif fresh:
                if offset is None and at >= part.end:
                    return
                heading = False
            if offset is not None:
                yield offset, heading, piece


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path = options["path"]
        self.start = options.get("start", "").encode()
        self.size = int(options.get("splitbytes", 1 << 27))
        self.chunk = int(options.get("chunk", 0))

    def partitions(self) -> list[ByteRange]:
        out = []
        for number, (path, size) in enumerate(_files(self.path)):
            if size >> OFFSET_BITS:
                raise ValueError(f"{path}: files of 2^{OFFSET_BITS} bytes and more have no ids")
            out += [ByteRange(path, number, at, min(at + self.size, size)) for at in range(0, size, self.size)]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.end == 0:
            return
        rows = self._chunks(partition) if self.chunk else self._whole(partition)
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[-1])
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _whole(self, part: ByteRange) -> Iterator[tuple]:
        begun, pieces = None, []
        for offset, _, piece in _records(part, self.start):
            if offset != begun and begun is not None:
                yield (part.number << OFFSET_BITS) + begun, part.path, begun, b"".join(pieces)
                pieces = []
            begun = offset
            pieces.append(piece)
        if begun is not None:
            yield (part.number << OFFSET_BITS) + begun, part.path, begun, b"".join(pieces)

    def _chunks(self, part: ByteRange) -> Iterator[tuple]:
        """Letters after a record's first line, `chunk` at a time as they are read: no record is held."""
        begun, head, number, held = None, b"", 0, bytearray()
        for offset, heading, piece in _records(part, self.start):
            if offset != begun:
                if held:
                    yield head, number, bytes(held)
                begun, head, number, held = offset, b"", 0, bytearray()
            if heading:
                head += piece
                continue
            held += piece.translate(None, b" \t\r\n")
            while len(held) >= self.chunk:
                yield head, number, bytes(held[: self.chunk])
                del held[: self.chunk]
                number += 1
        if held:
            yield head, number, bytes(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        text = lambda b: b.decode("utf-8", "replace")
        if self.chunk:
            heads, numbers, parts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(map(text, heads)), pa.array(numbers, pa.int64()), pa.array(map(text, parts))], ["head", "chunk", "part"])
        ids, files, offsets, values = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files), pa.array(offsets, pa.int64()), pa.array(map(text, values))], ["id", "file", "offset", "value"])


class RecordSource(DataSource):
    """Options: path; start, a pattern that a record's first line begins with (default: every line is a
    record); splitbytes; chunk, the letters of a piece, for records too long for a row."""

    @classmethod
    def name(cls) -> str:
        return "text_records"

    def schema(self) -> str:
        return "head string, chunk long, part string" if int(self.options.get("chunk", 0)) else "id long, file string, offset long, value string"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options, schema)
