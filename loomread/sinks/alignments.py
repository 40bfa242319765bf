"""Alignments as SAM lines and as BAM."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.schema import ALN
from loomread.sources.bam import BASES, NUMBERS, OPERATIONS, Header, header_text

#: Uncompressed bytes of a block, and the empty block that ends a file (fixed values of the format).
BLOCK = 0xFF00
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def sam_line() -> Column:
    """An alignment's line, tags in their order."""
    tags = F.transform("tags", lambda t: F.concat_ws(":", t["tag"], t["type"], t["value"]))
    fixed = ["qname", F.col("flag").cast("string"), F.coalesce("rname", F.lit("*")), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", "rnext", (F.col("pnext") + 1).cast("string"), F.col("tlen").cast("string"), "seq", "qual"]
    return F.concat_ws("\t", *fixed, tags)


def save_sam(alns: DataFrame, header: Header, out: BinaryIO, order: list[Column | str]) -> None:
    """A SAM file, streamed part by part."""
    out.write(header_text(header).encode())
    for r in alns.orderBy(*order).select(sam_line().alias("value")).toLocalIterator(prefetchPartitions=True):
        out.write(r["value"].encode() + b"\n")


def bgzf(raw: bytes) -> bytes:
    """Blocks of the blocked gzip format."""
    out = []
    for i in range(0, len(raw), BLOCK):
        part = raw[i : i + BLOCK]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def _bin(begin: int, end: int) -> int:
    """The index bin of a span: the smallest that holds it."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def _tag_bytes(tag: str, kind: str, value: str) -> bytes:
    head = tag.encode()
    if kind == "i":
        n = int(value)
        return head + (b"i" + struct.pack("<i", n) if -(1 << 31) <= n < 1 << 31 else b"I" + struct.pack("<I", n))
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind == "A":
        return head + b"A" + value.encode()[:1]
    if kind == "B":
        own, *values = value.split(",")
        numbers = [float(v) if own == "f" else int(v) for v in values]
        return head + b"B" + own.encode() + struct.pack(f"<i{len(numbers)}{NUMBERS[own]}", len(numbers), *numbers)
    return head + kind.encode() + value.encode() + b"\0"


def bam_record(row: dict, contigs: dict[str, int]) -> bytes:
    """A record's bytes, with their length before them."""
    ops, n = [], 0
    for c in "" if row["cigar"] in (None, "*") else row["cigar"]:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            ops.append(n << 4 | OPERATIONS.index(c))
            n = 0
    ahead = sum(x >> 4 for x in ops if OPERATIONS[x & 15] in "MDN=X")
    seq = "" if row["seq"] == "*" else row["seq"]
    codes = [BASES.find(b) if b in BASES else 15 for b in seq.upper()] + [0] * (len(seq) & 1)
    qual = b"\xff" * len(seq) if row["qual"] == "*" else bytes(ord(q) - 33 for q in row["qual"])
    ref = contigs.get(row["rname"], -1) if row["rname"] else -1
    next_ref = ref if row["rnext"] == "=" else contigs.get(row["rnext"], -1)
    name = row["qname"].encode() + b"\0"
    pos = row["pos"]
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name), row["mapq"], _bin(max(pos, 0), max(pos, 0) + max(ahead, 1)) if pos >= 0 else 4680, len(ops), row["flag"], len(seq), next_ref, row["pnext"], row["tlen"])
    body += name + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + qual
    body += b"".join(_tag_bytes(t["tag"], t["type"], t["value"]) for t in row["tags"] or [])
    return struct.pack("<i", len(body)) + body


def save_bam(alns: DataFrame, header: Header, out: BinaryIO, order: list[Column | str]) -> None:
    """A BAM file: tasks encode and compress their ranges, the driver puts the blocks one after the other."""
    text = header_text(header).encode()
    names = [(s["SN"], int(s.get("LN", 0))) for s in header.get("SQ", [])]
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in names)
    out.write(bgzf(head))
    contigs = {n: i for i, (n, _) in enumerate(names)}

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([bgzf(b"".join(bam_record(r, contigs) for r in b.to_pylist()))], pa.binary())], ["blocks"])

    for r in alns.orderBy(*order).select(*ALN.fieldNames()).mapInArrow(encode, "blocks binary").toLocalIterator(prefetchPartitions=True):
        out.write(r["blocks"])
    out.write(END)


def write_sam_parts(alns: DataFrame, path: str, order: list[Column | str]) -> None:
    """SAM lines as part files under ``path``, without a header."""
    from loomread.sinks.lines import write_lines

    write_lines(alns.select("*", sam_line().alias("value")), path, order)


__all__ = ["bam_record", "bgzf", "sam_line", "save_bam", "save_sam", "write_sam_parts"]
