"""Alignments to molecules: runs of one barcode on a contig without a gap above a cutoff."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomread.functions import alignments as A
from loomread.functions import barcodes as B
from loomread.plans.ordinals import with_ordinal
from loomread.plans.storage import written


def classified(alns: DataFrame, keep_unmapped: bool = False) -> DataFrame:
    """``alns`` with ``part``: ``molecule``, ``invalid`` (kept without molecule), ``missing`` (no barcode) or ``drop``."""
    loose = F.when(F.lit(keep_unmapped), "invalid").otherwise("drop")
    part = F.when(F.col("is_unmapped") & F.lit(not keep_unmapped), "drop")
    part = part.when(F.col("vx") == 0, F.when(F.col("bx").isNull(), "missing").otherwise("invalid"))
    part = part.when(F.col("bx").isNull() | F.col("vx").isNull(), "missing").when(F.col("aln_start").isNull(), loose).otherwise("molecule")
    return alns.withColumn("part", part)


def _by_first(rows: DataFrame) -> DataFrame:
    """One molecule for each barcode on a contig."""
    starts = rows.groupBy("rname", "bx").agg(F.min("rec_idx").alias("start_rec"))
    return rows.join(starts.withColumnRenamed("rname", "__c").withColumnRenamed("bx", "__b"), F.col("rname").eqNullSafe(F.col("__c")) & (F.col("bx") == F.col("__b"))).select("rec_idx", "start_rec")


def _by_lag(rows: DataFrame, cutoff: int) -> DataFrame:
    """Molecules where each alignment moves the end (no forward mates): gaps to the row before."""
    order = Window.partitionBy("rname", "bx").orderBy("rec_idx")
    last = F.lag("aln_end").over(order)
    start = F.when(last.isNull() | (F.col("aln_start") - last > cutoff), F.col("rec_idx"))
    return rows.withColumn("start", start).select("rec_idx", F.max("start").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("start_rec"))


def _by_scan(rows: DataFrame, cutoff: int) -> DataFrame:
    """Molecules in general: a forward mate that doesn't begin one leaves the end where it is, so that the gap test
    depends on itself. Rows come sorted by contig, barcode and place; one state is carried from row to row, however
    large a group is."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, start = None, 0, 0
        for b in it:
            starts = []
            for contig, bx, rec, begin, end, moves in zip(*(b.column(c).to_pylist() for c in ("rname", "bx", "rec_idx", "aln_start", "aln_end", "moves")), strict=True):
                new = (contig, bx) != key or (cutoff > 0 and begin - last > cutoff)
                if new:
                    key, start = (contig, bx), rec
                if new or moves:
                    last = end
                starts.append(start)
            yield pa.RecordBatch.from_arrays([b.column("rec_idx"), pa.array(starts, pa.int64())], ["rec_idx", "start_rec"])

    keyed = rows.select("rname", "bx", "rec_idx", "aln_start", "aln_end", (F.col("is_reverse") | ~F.col("is_paired")).alias("moves"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "rname", "bx").sortWithinPartitions("rname", "bx", "rec_idx").mapInArrow(run, "rec_idx long, start_rec long")


def molecule_starts(rows: DataFrame, cutoff: int = 0, paired: bool = True) -> DataFrame:
    """``rec_idx, start_rec``: the record that each alignment's molecule began with."""
    if cutoff <= 0:
        return _by_first(rows)
    return _by_scan(rows, cutoff) if paired else _by_lag(rows, cutoff)


def assign_molecules(alns: DataFrame, chemistry: str, cutoff: int = 0, keep_unmapped: bool = False, paired: bool = True) -> DataFrame:
    """Coordinate-sorted ``alns`` (with their promoted columns) with ``mi``, and tags and ``bx``, ``dx`` as written.

    ``paired=False`` is for data without forward mates, which needs no scan. Molecules are numbered from 1 in the order
    of their first record.
    """
    rows = classified(alns, keep_unmapped).where("part <> 'drop'")
    starts = written(molecule_starts(rows.where("part = 'molecule'"), cutoff, paired), "molecule-starts")
    numbers = with_ordinal(starts.select("start_rec").distinct(), ["start_rec"], "n")
    mi = starts.join(numbers, "start_rec").select("rec_idx", (F.col("n") + 1).alias("new_mi"))
    out = rows.join(mi, "rec_idx", "left")
    missing = B.INVALID[B.TELLSEQ if chemistry == B.TENX else chemistry]
    cut, suffixed = A.deconvolved(F.col("bx"))
    gone = F.col("part") == "missing"
    bx = F.when(gone, missing).otherwise(cut)
    found: Column = F.col("part") == "molecule"
    tags = A.with_tags(A.without_tags("MI", "DI", "BX"), (found, A.tag("MI", "i", F.col("new_mi"))), (found & suffixed, A.tag("DX", "Z", F.col("bx"))), (None, A.tag("BX", "Z", bx)))
    dx = F.when(found & suffixed, F.col("bx")).otherwise(F.col("dx"))
    return out.withColumns({"tags": tags, "dx": dx, "mi": F.col("new_mi")}).withColumn("bx", bx).drop("new_mi", "part")
