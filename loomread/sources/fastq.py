"""FASTQ files as rows: ``spark.read.format("loomread_fastq")``."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loomread.errors import LinkedReadError
from loomread.schema import READ
from loomread.sources.files import check_fastq_paths
from loomread.sources.splits import Span, as_dict, lines_of, spans

_ROWS = 8192
#: Reads that each pair of files has room for, in ``rec_idx``.
PAIR_SHIFT = 40


class _Part(InputPartition):
    def __init__(self, span: Span, file_idx: int, first: int) -> None:
        self.span, self.file_idx, self.first = span, file_idx, first


def records(span: Span) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Place, head, sequence and quality of each record of four lines that begins in a span."""
    whole = span.size < 0
    empty = 0
    for n, f in lines_of(span, 4):
        head = f.readline().rstrip(b"\r\n")
        while whole and not head and not f.over():  # empty lines between records, in files that one task reads
            head = f.readline().rstrip(b"\r\n")
        if not head:
            empty += 1
            continue
        seq, plus, qual = (f.readline().rstrip(b"\r\n") for _ in range(3))
        if head[:1] != b"@" or plus[:1] != b"+" or len(seq) != len(qual):
            raise LinkedReadError(f"not a FASTQ record in {span.path}: {head[:80]!r}")
        yield n - empty, head, seq, qual


class FastqReader(DataSourceReader):
    def __init__(self, pairs: list[list[list[dict]]], columns: list[str]) -> None:
        self.pairs, self.columns = pairs, columns

    def partitions(self) -> list[InputPartition]:
        return [_Part(Span(**s), i, n << PAIR_SHIFT) for n, pair in enumerate(self.pairs) for i, spans_ in enumerate(pair) for s in spans_]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        rows: list[tuple] = []
        named = bool({"name", "comment"} & set(self.columns))

        def batch() -> pa.RecordBatch:
            place, head, seq, qual = zip(*rows, strict=True)
            parts = [h[1:].decode().split(None, 1) for h in head] if named else []
            made = {
                "file_idx": lambda: pa.array([partition.file_idx] * len(rows), pa.int32()),
                "rec_idx": lambda: pa.array([partition.first + n for n in place], pa.int64()),
                "name": lambda: pa.array([p[0] if p else "" for p in parts], pa.string()),
                "comment": lambda: pa.array([p[1] if len(p) > 1 else None for p in parts], pa.string()),
                "seq": lambda: pa.array([x.decode() for x in seq], pa.string()),
                "qual": lambda: pa.array([x.decode() for x in qual], pa.string()),
            }
            out = pa.RecordBatch.from_arrays([made[c]() for c in self.columns], self.columns)
            rows.clear()
            return out

        for r in records(partition.span):
            rows.append(r)
            if len(rows) >= _ROWS:
                yield batch()
        if rows:
            yield batch()


class FastqSource(DataSource):
    """Options: ``pairs``, a JSON list of lists of one or two lists of spans; ``columns``, a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "loomread_fastq"

    def _columns(self) -> list[str]:
        return json.loads(self.options["columns"])

    def schema(self):  # noqa: ANN201
        return StructType([READ[c] for c in self._columns()])

    def reader(self, schema) -> FastqReader:  # noqa: ANN001
        return FastqReader(json.loads(self.options["pairs"]), self._columns())


def read_fastq(spark: SparkSession, *paths: str, columns: list[str] | None = None, step: int | None = None) -> DataFrame:
    """Reads of one file or of a forward and a reverse file; their places meet in ``rec_idx``."""
    return read_fastq_pairs(spark, [list(paths)], columns, step)


def read_fastq_pairs(spark: SparkSession, pairs: list[list[str]], columns: list[str] | None = None, step: int | None = None) -> DataFrame:
    """Reads of many files or pairs of files.

    Large plain and BGZF files are read range by range (``step`` stored bytes each), by a task each; a gzip file of one
    piece can't be split. ``columns``: which of a read's columns are made, all by default.
    """
    for pair in pairs:
        check_fastq_paths(pair)
    spark.dataSource.register(FastqSource)
    cut = spans(spark, list(dict.fromkeys(p for pair in pairs for p in pair)), step)
    own = [[[as_dict(s) for s in cut if s.path == p] for p in pair] for pair in pairs]
    return spark.read.format("loomread_fastq").option("pairs", json.dumps(own)).option("columns", json.dumps(columns or READ.fieldNames())).load()
