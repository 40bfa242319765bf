"""Rendered reads as FASTQ: ``PREFIX.R1.fq.gz`` and ``PREFIX.R2.fq.gz``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.functions.reads import fastq_record
from loomread.sinks.lines import save_lines, write_lines


def _side(rendered: DataFrame, forward: bool) -> DataFrame:
    order = [c for c in ("rec_idx", "k") if c in rendered.columns]
    return rendered.where(F.col("forward") if forward else ~F.col("forward")).select(*order, fastq_record().alias("value"))


def _order(rendered: DataFrame) -> list[str]:
    return [c for c in ("rec_idx", "k") if c in rendered.columns]


def write_fastq(rendered: DataFrame, prefix: str, paired: bool = True) -> None:
    """Directories of gzip parts, forward and reverse reads apart, in the order of ``rec_idx``; read by a glob, or put
    one after the other as a gzip file. A lone file's reads all go to ``R1``."""
    for n, forward in ((1, True), (2, False)) if paired else ((1, None),):
        rows = _side(rendered, forward) if forward is not None else rendered.select(*_order(rendered), fastq_record().alias("value"))
        write_lines(rows, f"{prefix}.R{n}.fq.gz.parts", _order(rendered), "gzip")


def save_fastq(rendered: DataFrame, prefix: str, paired: bool = True) -> None:
    """As single gzip files, streamed through the driver part by part: for commands on single files."""
    for n, forward in ((1, True), (2, False)) if paired else ((1, None),):
        rows = _side(rendered, forward) if forward is not None else rendered.select(*_order(rendered), fastq_record().alias("value"))
        save_lines((r["value"] for r in rows.orderBy(*_order(rendered)).select("value").toLocalIterator(prefetchPartitions=True)), f"{prefix}.R{n}.fq.gz")
