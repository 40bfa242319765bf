"""Ranges of large text files, plain or in BGZF blocks, for several tasks to read.

A range begins at a byte of a plain file, or at the first block at or after a byte of a BGZF file. What a task needs of
those before it is the number of lines that they hold: a pass that only decompresses and counts finds it, in parallel.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomread.sources.files import open_bytes, open_raw

#: Bytes of a range as stored; files of up to twice as many are one range.
RANGE = 128 << 20
_CHUNK = 1 << 20
_BLOCK = b"\x1f\x8b\x08\x04"


@dataclass(frozen=True)
class Span:
    """A range of a file: ``start`` as stored; its ``size`` in decompressed bytes (-1: to the file's end); the number of
    line ends before it, and whether it begins a line."""

    path: str
    start: int = 0
    size: int = -1
    before: int = 0
    begins: bool = True


def block_size(head: bytes) -> int:
    """The stored size of the BGZF block with this beginning; 0 if it isn't one."""
    if len(head) < 18 or head[:4] != _BLOCK:
        return 0
    extra, at = 12 + struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(extra, len(head)):
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return 0


def first_block(f: BinaryIO, start: int, size: int) -> int:
    """Where the first block at or after ``start`` begins: one that another block or the file's end follows."""
    at, held = start, b""
    f.seek(start)
    while True:
        held += f.read(_CHUNK)
        i = -1
        while (i := held.find(_BLOCK, i + 1)) >= 0:
            here = at + i
            n = block_size(held[i : i + 64] if len(held) - i >= 64 else _at(f, here, 64))
            if n and (here + n == size or block_size(_at(f, here + n, 64))):
                return here
        if at + len(held) >= size:
            return size
        at, held = at + len(held) - 3, held[-3:]
        f.seek(at + 3)


def _at(f: BinaryIO, place: int, n: int) -> bytes:
    f.seek(place)
    return f.read(n)


def open_at(path: str, start: int) -> BinaryIO:
    """The decompressed bytes of a file from a range's start on."""
    if start == 0:
        return open_bytes(path)
    raw, _ = open_raw(path)
    head = _at(raw, 0, 64)
    raw.seek(start)
    return gzip.GzipFile(fileobj=raw) if block_size(head) else raw  # type: ignore[return-value]


def _ranges(path: str, step: int) -> list[tuple[str, int, int]]:
    """Path, start and end of the ranges of a file that can be split; none for others."""
    raw, size = open_raw(path)
    with raw:
        head = raw.read(64)
    if size <= 2 * step or head[:2] == b"\x1f\x8b" and not block_size(head):
        return []
    return [(path, a, min(a + step, size)) for a in range(0, size, step)]


def spans(spark: SparkSession, paths: list[str], step: int | None = None) -> list[Span]:
    """The ranges of all ``paths``, in their order. Only ranges, not lines, come to the driver."""
    step = step or RANGE
    cut = {p: _ranges(p, step) for p in paths}
    todo = [r for p in paths for r in cut[p]]
    if not todo:
        return [Span(p) for p in paths]

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [_counted(*r) for r in zip(*(b.column(c).to_pylist() for c in ("path", "first", "after")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.bool_())], ["path", "start", "size", "lines", "ended"])

    rows: DataFrame = spark.createDataFrame(todo, "path string, first long, after long").repartition(len(todo), F.col("first"), F.col("path"))
    found = rows.mapInArrow(count, "path string, start long, size long, lines long, ended boolean").collect()  # a row for each range
    out = []
    for p in paths:
        lines, begins = 0, True
        mine = sorted((r for r in found if r["path"] == p and r["size"]), key=lambda r: r["start"])
        out += [] if mine else [Span(p)]
        for r in mine:
            out.append(Span(p, r["start"], r["size"], lines, begins))
            lines, begins = lines + r["lines"], r["ended"]
    return out


def _counted(path: str, first: int, after: int) -> tuple[int, int, int, bool]:
    """Start, decompressed size, line ends and whether the last byte ends a line, of a range."""
    raw, size = open_raw(path)
    with raw:
        start, end = first, after
        if block_size(_at(raw, 0, 64)):
            start, end = (first_block(raw, x, size) if x else 0 for x in (first, after))
    total = lines = 0
    last = b"\n"
    with open_at(path, start) as f:
        left = end - start
        blocks = hasattr(f, "fileobj")
        while left > 0:
            part = _block(f.fileobj, end) if blocks else f.read(min(_CHUNK, left))  # type: ignore[attr-defined]
            if not part and not blocks:
                break
            if blocks:
                left = end - f.fileobj.tell()  # type: ignore[attr-defined]
            else:
                left -= len(part)
            total, lines, last = total + len(part), lines + part.count(b"\n"), part[-1:] or last
    return start, total, lines, last == b"\n"


def _block(raw: BinaryIO, end: int) -> bytes:
    """The decompressed bytes of the block at the file's place."""
    head = raw.read(18)
    n = block_size(head)
    if not n:
        raise ValueError("a BGZF block is broken")
    return zlib.decompress(head + raw.read(n - 18), 31)


def lines_of(span: Span, every: int = 1, skip: int = 0) -> Iterator[tuple[int, BinaryIO]]:
    """(number, stream) at the beginning of each record of ``every`` lines that begins in the span; the caller reads the
    record off the stream. ``skip``: lines before the first record of the file."""
    with open_at(span.path, span.start) as f:
        number, read = span.before, 0
        if not span.begins:  # the rest of a line that began before
            read, number = len(f.readline()), number + 1
        while (number < skip or (number - skip) % every) and (line := f.readline()):
            read, number = read + len(line), number + 1
        stream = _Counting(f, read)
        while (span.size < 0 or stream.read < span.size) and not stream.over():
            yield (number - skip) // every, stream
            number += every


class _Counting:
    """Lines of a stream, and how many bytes they had."""

    def __init__(self, f: BinaryIO, read: int) -> None:
        self.f, self.read, self.next = f, read, b""

    def over(self) -> bool:
        self.next = self.next or self.f.readline()
        return not self.next

    def readline(self) -> bytes:
        line, self.next = self.next or self.f.readline(), b""
        self.read += len(line)
        return line


def as_dict(span: Span) -> dict:
    return asdict(span)
