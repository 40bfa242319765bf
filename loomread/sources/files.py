"""Byte streams by path: local files, or any store that pyarrow's file systems reach; plain or gzip."""

from __future__ import annotations

import gzip
import io
import os
import re
from typing import BinaryIO

from loomread.errors import LinkedReadError


def open_raw(path: str) -> tuple[BinaryIO, int]:
    """The stored bytes of a file, with ``seek``, and how many there are."""
    if re.match(r"[a-z][a-z0-9+.-]*://", path, re.I) and not path.startswith("file://"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        f = store.open_input_file(inner)
        return io.BufferedReader(f), f.size()  # type: ignore[arg-type]
    raw = open(path.removeprefix("file://"), "rb")  # noqa: SIM115
    return raw, os.fstat(raw.fileno()).st_size


def open_bytes(path: str) -> BinaryIO:
    """The decompressed bytes of a file; gzip is told by its first two bytes (also BGZF and other member files)."""
    raw, _ = open_raw(path)
    head = raw.peek(2)[:2]  # type: ignore[attr-defined]
    return gzip.GzipFile(fileobj=raw) if head == b"\x1f\x8b" else raw  # type: ignore[return-value]


def check_fastq_paths(paths: list[str]) -> list[str]:
    """One or two different paths with a FASTQ name."""
    if not 1 <= len(paths) <= 2:
        raise LinkedReadError("one or two FASTQ files are needed")
    if len(set(paths)) != len(paths):
        raise LinkedReadError("the two FASTQ files are the same")
    for p in paths:
        if not re.search(r"\.(fq|fastq)(\.gz)?$", p, re.I):
            raise LinkedReadError(f"not a FASTQ name (.fq, .fastq, with or without .gz): {p}")
    return paths


def check_sam_paths(paths: list[str]) -> list[str]:
    """Paths with a SAM or BAM name."""
    for p in paths:
        if not re.search(r"\.(sam|bam)$", p, re.I):
            raise LinkedReadError(f"not a SAM or BAM name: {p}")
    return paths
