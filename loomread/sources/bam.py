"""SAM and BAM files as rows: ``spark.read.format("loomread_alignments")``; headers as dictionaries."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomread.errors import LinkedReadError
from loomread.functions.alignments import promoted
from loomread.schema import ALN
from loomread.sources.files import check_sam_paths, open_bytes
from loomread.sources.splits import Span, as_dict, lines_of, spans

_ROWS = 4096
# Fixed values of the format: operations, bases, and the numbers that tags hold.
OPERATIONS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
Header = dict[str, list[dict[str, str]]]


def parse_header(text: str) -> Header:
    """Header lines by their type, each a dictionary; comments under ``CO`` as ``{"": text}``."""
    out: Header = {}
    for line in text.splitlines():
        if line.startswith("@CO"):
            out.setdefault("CO", []).append({"": line[4:]})
        elif line.startswith("@"):
            kind, *fields = line[1:].split("\t")
            out.setdefault(kind, []).append(dict(f.split(":", 1) for f in fields if ":" in f))
    return out


def header_text(header: Header) -> str:
    order = ["HD", "SQ", "RG", "PG", "CO"]
    kinds = [k for k in order if k in header] + [k for k in header if k not in order]
    lines = [f"@{k}\t" + ("\t".join(f"{t}:{v}" for t, v in row.items()) if k != "CO" else row.get("", "")) for k in kinds for row in header[k]]
    return "".join(f"{x}\n" for x in lines)


def _tag_text(raw: bytes, at: int) -> tuple[tuple[str, str, str], int]:
    """A tag of a BAM record as text; where the next one begins. Whole numbers are all of type ``i``."""
    name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
    at += 3
    if kind in NUMBERS:
        code = NUMBERS[kind]
        (value,) = struct.unpack_from(f"<{code}", raw, at)
        return (name, "f" if kind == "f" else "i", f"{value:g}" if kind == "f" else str(value)), at + struct.calcsize(code)
    if kind == "A":
        return (name, "A", chr(raw[at])), at + 1
    if kind in "ZH":
        end = raw.index(b"\0", at)
        return (name, kind, raw[at:end].decode()), end + 1
    if kind == "B":
        own = chr(raw[at])
        (n,) = struct.unpack_from("<i", raw, at + 1)
        values = struct.unpack_from(f"<{n}{NUMBERS[own]}", raw, at + 5)
        return (name, "B", ",".join([own, *(f"{v:g}" if own == "f" else str(v) for v in values)])), at + 5 + n * struct.calcsize(NUMBERS[own])
    raise LinkedReadError(f"unknown tag type {kind}")


def _take(f: BinaryIO, n: int) -> bytes:
    raw = f.read(n)
    if len(raw) != n:
        raise LinkedReadError("a BAM file ends early")
    return raw


def read_bam_head(f: BinaryIO) -> tuple[Header, list[str]]:
    if f.read(4) != b"BAM\1":
        raise LinkedReadError("not a BAM file")
    (n,) = struct.unpack("<i", _take(f, 4))
    header = parse_header(_take(f, n).rstrip(b"\0").decode())
    (n,) = struct.unpack("<i", _take(f, 4))
    names = []
    for _ in range(n):
        (size,) = struct.unpack("<i", _take(f, 4))
        names.append(_take(f, size).rstrip(b"\0").decode())
        _take(f, 4)
    return header, names


def bam_records(path: str) -> Iterator[tuple]:
    """Fields of each record of a BAM file, positions from 0."""
    with open_bytes(path) as f:
        _, names = read_bam_head(f)
        contig = lambda i: names[i] if i >= 0 else None
        while head := f.read(4):
            raw = _take(f, struct.unpack("<i", head)[0])
            ref, pos, name_len, mapq, _, n_ops, flag, size, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
            at = 32
            qname = raw[at : at + name_len - 1].decode()
            at += name_len
            ops = struct.unpack_from(f"<{n_ops}I", raw, at)
            at += 4 * n_ops
            packed, at = raw[at : at + (size + 1) // 2], at + (size + 1) // 2
            seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:size]
            qual = raw[at : at + size]
            at += size
            tags = []
            while at < len(raw):
                tag, at = _tag_text(raw, at)
                tags.append(tag)
            cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops)
            rnext = "=" if next_ref >= 0 and next_ref == ref else contig(next_ref) or "*"
            text = "*" if not size or qual[:1] == b"\xff" else bytes(q + 33 for q in qual).decode()
            yield qname, flag, contig(ref), pos, mapq, cigar or "*", rnext, next_pos, tlen, seq or "*", text, tags


def sam_records(span: Span, header_lines: int) -> Iterator[tuple]:
    """Place and fields of each record of a SAM file that begins in a span, positions from 0."""
    for n, f in lines_of(span, 1, header_lines):
        line = f.readline()
        if not line.strip():
            continue
        p = line.rstrip(b"\r\n").decode().split("\t")
        if len(p) < 11:
            raise LinkedReadError(f"not a SAM record in {span.path}: {p[0][:80]!r}")
        tags = [tuple(t.split(":", 2)) for t in p[11:]]
        yield n, p[0], int(p[1]), None if p[2] == "*" else p[2], int(p[3]) - 1, int(p[4]), p[5], p[6], int(p[7]) - 1, int(p[8]), p[9], p[10], tags


def read_header(path: str) -> Header:
    """The header of a SAM or BAM file."""
    with open_bytes(path) as f:
        if path.lower().endswith(".bam"):
            return read_bam_head(f)[0]
        lines = []
        for line in f:
            if line[:1] != b"@":
                break
            lines.append(line.decode())
        return parse_header("".join(lines))


def _header_lines(path: str) -> int:
    with open_bytes(path) as f:
        return next((n for n, line in enumerate(f) if line[:1] != b"@"), 0)


class _Part(InputPartition):
    def __init__(self, span: Span, file_idx: int) -> None:
        self.span, self.file_idx = span, file_idx


class AlignmentReader(DataSourceReader):
    def __init__(self, files: list[list[dict]]) -> None:
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return [_Part(Span(**s), i) for i, own in enumerate(self.files) for s in own]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(ALN)
        path = partition.span.path
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            tags = [[{"tag": t, "type": k, "value": v} for t, k, v in r] for r in cols[12]]
            values = [[partition.file_idx] * len(rows), *cols[:12], tags]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema.names)

        for r in ((n, *x) for n, x in enumerate(bam_records(path))) if path.lower().endswith(".bam") else sam_records(partition.span, _header_lines(path)):
            rows.append(r)
            if len(rows) >= _ROWS:
                yield batch()
        if rows:
            yield batch()


class AlignmentSource(DataSource):
    """Options: ``files``, a JSON list of lists of spans."""

    @classmethod
    def name(cls) -> str:
        return "loomread_alignments"

    def schema(self):  # noqa: ANN201
        return ALN

    def reader(self, schema) -> AlignmentReader:  # noqa: ANN001
        return AlignmentReader(json.loads(self.options["files"]))


def read_alignments(spark: SparkSession, *paths: str, step: int | None = None) -> DataFrame:
    """Records of SAM or BAM files in file order, with tags, flags and spans as columns.

    Large SAM files are read range by range, by a task each; a BAM file's records can't be told from a place within it, so
    that it is read by one.
    """
    check_sam_paths(list(paths))
    spark.dataSource.register(AlignmentSource)
    text = [p for p in paths if not p.lower().endswith(".bam")]
    cut = {p: [] for p in paths}
    for s in spans(spark, list(dict.fromkeys(text)), step):
        cut[s.path].append(as_dict(s))
    own = [cut[p] or [as_dict(Span(p))] for p in paths]
    return promoted(spark.read.format("loomread_alignments").option("files", json.dumps(own)).load())
