"""Which barcode format reads or alignments have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.errors import UndeterminedChemistry
from loomread.functions import barcodes as B

RECORDS = 100
NONE = "none"


def _first_kind(rows: DataFrame, kind: Column, limit: int) -> DataFrame:
    head = rows.select("rec_idx", kind.alias("kind")).orderBy("rec_idx").limit(limit)
    return head.agg(F.coalesce(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("rec_idx"))), F.lit(NONE)).alias("chemistry"))


def reads_chemistry(reads: DataFrame, limit: int = RECORDS) -> DataFrame:
    """One row ``chemistry``: of the first matching record among the first ``limit``, else ``none``."""
    kind = F.when(F.coalesce("comment", F.lit("")).rlike(B.IN_COMMENT[B.HAPLOTAGGING]), B.HAPLOTAGGING)
    for style, pattern in B.IN_NAME.items():
        kind = kind.when(F.col("name").rlike(pattern), style)
    return _first_kind(reads, kind, limit)


def alignments_chemistry(alns: DataFrame, limit: int = RECORDS) -> DataFrame:
    """As :func:`reads_chemistry`, by the ``bx`` column; records without one count among the ``limit``."""
    kind = None
    for style, pattern in B.IN_TAG.items():
        kind = (F if kind is None else kind).when(F.col("bx").rlike(pattern), style)
    return _first_kind(alns, kind, limit)


def is_standard(alns: DataFrame) -> DataFrame:
    """One row ``standard``: whether any record has both VX and BX."""
    return alns.where(F.col("bx").isNotNull() & F.col("vx").isNotNull()).limit(1).agg((F.count("*") > 0).alias("standard"))


def require(found: DataFrame) -> str:
    """The chemistry that was found; an error if there is none."""
    kind = found.first()["chemistry"]
    if kind == NONE:
        raise UndeterminedChemistry(f"no haplotagging, stlfr or tellseq barcodes in the first {RECORDS} records")
    return kind
